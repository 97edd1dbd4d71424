"""Canonical ids by exact lookup and slugs for terms not known yet (SEQ-7, JOIN-12, SET-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import slug


def canonical_terms(facts: DataFrame, known: DataFrame) -> DataFrame:
    """``kind, raw, canon_id, is_new`` of all distinct terms; unknown ones get their slug."""
    t = facts.select(F.explode(F.array(F.struct(F.lit("subject").alias("kind"), F.col("subject").alias("raw")),
                                       F.struct(F.lit("metric").alias("kind"), F.col("metric").alias("raw")))).alias("x"))
    t = t.select("x.kind", "x.raw").where("raw is not null").distinct()
    k = known.groupBy("kind", "raw").agg(F.min("canon_id").alias("canon_id"))
    return t.join(k, ["kind", "raw"], "left").select("kind", "raw", F.coalesce("canon_id", slug(F.col("raw"))).alias("canon_id"), F.col("canon_id").isNull().alias("is_new"))


def with_ids(facts: DataFrame, terms: DataFrame) -> DataFrame:
    """``id, entity_id, metric_id`` looked up by the raw terms (SNK-9)."""
    s = terms.where("kind = 'subject'").groupBy(F.col("raw").alias("subject")).agg(F.min("canon_id").alias("entity_id"))
    m = terms.where("kind = 'metric'").groupBy(F.col("raw").alias("metric")).agg(F.min("canon_id").alias("metric_id"))
    return facts.select("id", "subject", "metric").join(s, "subject", "left").join(m, "metric", "left").select("id", "entity_id", "metric_id")
