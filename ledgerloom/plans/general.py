"""Queries of the general problems (3 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import timestamps, units_history
from ledgerloom.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    q = units_history.normalise_quantities(
        table(spark, d, "facts").where("canon_value is not null and canon_unit is not null"), table(spark, d, "evidence"))
    return units_history.wrong_pairs(units_history.unit_history(q, table(spark, d, "documents")))


def p3_quantities(spark: SparkSession, d: str) -> DataFrame:
    q = units_history.normalise_quantities(table(spark, d, "facts"), table(spark, d, "evidence"))
    return q.select(q.id.alias("fact_id"), q.value.alias("canon_value"), q.unit.alias("canon_unit"))


def p3_unit_changes(spark: SparkSession, d: str) -> DataFrame:
    q = units_history.normalise_quantities(table(spark, d, "facts"), table(spark, d, "evidence"))
    return units_history.unit_changes(units_history.unit_history(q, table(spark, d, "documents")))


def _periods(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise_periods(table(spark, d, "facts"), table(spark, d, "documents"), table(spark, d, "source_info"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "facts").where("period_start is not null and period_end is not null and period_kind is not null")
    return timestamps.wrong_periods(timestamps.normalise_periods(stored, table(spark, d, "documents"), table(spark, d, "source_info")))


def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    n = _periods(spark, d)
    return n.select(n.id.alias("fact_id"), "period_start", "period_end", "period_kind")


QUERIES = {"p3_found": p3_found, "p3_quantities": p3_quantities, "p3_unit_changes": p3_unit_changes,
           "p4_found": p4_found, "p4_periods": p4_periods}
