"""Spark-native engine for evidence-grounded facts and their relations."""
