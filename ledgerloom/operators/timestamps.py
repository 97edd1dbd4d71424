"""Mixed timestamp and period notations to one form (problem 4)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.timeparse import parse_period

_TYPE = pa.struct([("period_start", pa.string()), ("period_end", pa.string()), ("period_kind", pa.string())])


@F.arrow_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("period_start", "period_end", "period_kind")]))
def _parse(key: pa.Array) -> pa.Array:
    """Each distinct (text, order, zone) of a batch is parsed once."""
    d = key.dictionary_encode()
    out = []
    for k in d.dictionary.to_pylist():
        raw, order, tz = k.split("\x01")
        p = parse_period(raw, order or "dmy", tz or "UTC")
        out.append(None if p is None else {"period_start": p[0], "period_end": p[1], "period_kind": p[2]})
    return pa.array(out, type=_TYPE).take(d.indices)


def parsed_period(raw: Column, order: Column, tz: Column) -> Column:
    """Struct (period_start, period_end, period_kind); null where no definite period is stated."""
    key = F.concat_ws("\x01", F.translate(raw, "\x01", " "), F.coalesce(order, F.lit("")), F.coalesce(tz, F.lit("")))
    return _parse(F.when(raw.isNotNull(), key))


def normalise_periods(facts: DataFrame, documents: DataFrame, source_info: DataFrame) -> DataFrame:
    """``id``, stored triple (``was_*``) and stated triple of every fact.

    A clock time without a zone is local to its source; dates in digits with
    slashes follow the source's order.  Facts whose document or source is
    unknown (or null) are read as day-month-year in UTC.  Null or empty
    ``period_raw``, vague words and dates that do not exist give three nulls.
    A repeated fact row gives a repeated result row.  Only facts whose text can
    depend on the source travel to the documents; the others stay in place.
    """
    f = facts.select("id", "doc_id", "period_raw", *[F.col(c).alias(f"was_{c}") for c in ("period_start", "period_end", "period_kind")])
    # Slashes and wall-clock times are the only notations that need the source.
    needs = F.coalesce(F.col("period_raw").rlike(r"\d/\d{1,2}/\d|\d:\d|\d{8}[tT]\d{4}"), F.lit(False))
    info = source_info.groupBy("source").agg(F.min("tz").alias("tz"), F.min("date_order").alias("date_order"))
    where = (documents.where("doc_id is not null and source is not null").select("doc_id", "source")
             .join(info, "source", "left").groupBy("doc_id").agg(F.min("tz").alias("tz"), F.min("date_order").alias("date_order")))
    with_source = f.where(needs).join(where, "doc_id", "left")
    without = f.where(~needs).withColumns({"tz": F.lit(None).cast("string"), "date_order": F.lit(None).cast("string")})
    both = with_source.select(*without.columns).unionByName(without)
    p = both.withColumn("p", parsed_period(F.col("period_raw"), F.col("date_order"), F.col("tz")))
    return p.select("id", "was_period_start", "was_period_end", "was_period_kind", "p.period_start", "p.period_end", "p.period_kind")


def wrong_periods(normalised: DataFrame) -> DataFrame:
    """``fact_id`` of facts whose stored triple is not what the text states."""
    kept = normalised.where("was_period_start is not null and was_period_end is not null and was_period_kind is not null")
    same = F.lit(True)
    for c in ("period_start", "period_end", "period_kind"):
        same = same & F.col(c).eqNullSafe(F.col(f"was_{c}"))
    return kept.where(~same).select(F.col("id").alias("fact_id"))
