"""Writes as rewrites: insert-or-get, upserts, cascade deletes (SNK-1 to SNK-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BOX = "x0 double, y0 double, x1 double, y1 double"
#: Tables of a store and their columns.
SCHEMAS = {
    "documents": "doc_id bigint, sha256 string, filename string, title string, text string, page_count int, created_at timestamp, ingest_complete boolean",
    "blocks": f"id bigint, doc_id bigint, page_no int, block_index int, text string, is_boilerplate boolean, {_BOX}",
    "facts": "id bigint, doc_id bigint, subject string, metric string, value_raw string, unit_raw string, period_raw string, qualifiers map<string,string>, claim_type string, confidence double, "
             "canon_value double, canon_unit string, period_start string, period_end string, period_kind string, entity_id string, metric_id string",
    "evidence": f"fact_id bigint, quote string, page_no int, char_start int, char_end int, block_ids array<bigint>, {_BOX}",
    "relations": "fact_a bigint, fact_b bigint, rule_verdict string, model_verdict string, final_verdict string, reason_code string, explanation string, qualifier_diff string, claimed_transform string, "
                 "verified boolean, agreed boolean, confidence double",
    "gaps": "doc_id bigint, page_no int, reason string",
    "rejected": "doc_id bigint, payload string, reason string",
    "cache": "key string, response string",
    "terms": "kind string, raw string, canon_id string, label string",
}


def empty_store(spark: SparkSession) -> dict[str, DataFrame]:
    """A store without rows (SNK-11)."""
    return {k: spark.createDataFrame([], v) for k, v in SCHEMAS.items()}


def opened(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of an older store with what they lack: absent columns are null, absent tables empty (SNK-11)."""
    out = {}
    for name, none in empty_store(spark).items():
        have = tables.get(name, none)
        out[name] = with_missing_columns(have, {f.name: F.lit(None).cast(f.dataType) for f in none.schema})
    return out


def insert_or_get(documents: DataFrame) -> DataFrame:
    """``sha256, doc_id, uploads``: the first id of each content; later uploads get it (SNK-1)."""
    return documents.where("sha256 is not null").groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("uploads"))


def new_documents(arrived: DataFrame, known: DataFrame) -> DataFrame:
    """Arrived rows whose content is not known yet, one per content (the smallest doc_id)."""
    first = arrived.join(known.select("sha256").distinct(), "sha256", "left_anti")
    keep = first.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
    return first.join(keep, ["sha256", "doc_id"]).dropDuplicates(["sha256"])


def keep_latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Last row per key by an order (SNK-6, 7, 8); one aggregate, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows and the old ones without a new row of their key."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def prune(relations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Relations that are still candidates (a choice the default upsert does not make)."""
    return relations.join(candidates.select("fact_a", "fact_b").distinct(), ["fact_a", "fact_b"], "left_semi")


def cascade_delete(doc_ids: DataFrame, facts: DataFrame, evidence: DataFrame, relations: DataFrame, blocks: DataFrame,
                   gaps: DataFrame | None = None, rejected: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables without the rows of some documents (SNK-5); gaps and rejected where they are given."""
    docs = doc_ids.select("doc_id").distinct()
    gone = facts.join(docs, "doc_id", "left_semi").select("id")
    of_fact = lambda df, c: df.join(gone.withColumnRenamed("id", c), c, "left_anti").select(*df.columns)
    of_doc = lambda df: df.join(docs, "doc_id", "left_anti").select(*df.columns)
    out = {"facts": of_doc(facts), "evidence": of_fact(evidence, "fact_id"), "relations": of_fact(of_fact(relations, "fact_a"), "fact_b"), "blocks": of_doc(blocks)}
    return out | {k: of_doc(v) for k, v in (("gaps", gaps), ("rejected", rejected)) if v is not None}


def with_missing_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Schema migration: absent columns with their default (SNK-11)."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})
