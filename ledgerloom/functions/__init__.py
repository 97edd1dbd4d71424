"""Scalar building blocks: Column expressions and the parsers behind Arrow UDFs."""
