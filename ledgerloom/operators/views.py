"""Read queries as functions that give DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def one_quote(evidence: DataFrame) -> DataFrame:
    """First evidence row of each fact: ``fact_id, evidence_id, quote, page_no``."""
    e = evidence.where("fact_id is not null").groupBy("fact_id").agg(F.min_by(F.struct(F.col("id").alias("evidence_id"), "quote", "page_no"), "id").alias("e"))
    return e.select("fact_id", "e.evidence_id", "e.quote", "e.page_no")


def document_listing(documents: DataFrame, facts: DataFrame, gaps: DataFrame, rejected: DataFrame) -> DataFrame:
    """Each document with its counts (JOIN-6): counted first, then joined."""
    n = lambda df, c: df.groupBy("doc_id").agg(F.count("*").alias(c))
    d = documents.select("doc_id", "filename")
    for df, c in ((facts, "fact_count"), (gaps, "gap_count"), (rejected, "rejected_count")):
        d = d.join(n(df, c), "doc_id", "left")
    return d.fillna(0, ["fact_count", "gap_count", "rejected_count"])


def like(c: Column, q: str) -> Column:
    """Case-insensitive LIKE with live wildcards and no escape character (FLT-2)."""
    return c.ilike("%" + q.replace("\\", "\\\\") + "%")


def facts_search(facts: DataFrame, documents: DataFrame, evidence: DataFrame, entity: str | None = None, metric: str | None = None,
                 period: str | None = None, doc: int | None = None, q: str | None = None, limit: int | None = 200, offset: int = 0) -> DataFrame:
    """Facts with filename and quote by optional filters (FLT-1, FLT-2, SRT-1); a negative limit or None is none."""
    f = facts
    for value, name in ((entity, "entity_id"), (metric, "metric_id"), (period, "period_start"), (doc, "doc_id")):
        if value:
            f = f.where(F.col(name) == value)
    f = f.join(documents.select("doc_id", "filename"), "doc_id").join(one_quote(evidence).withColumnRenamed("fact_id", "id"), "id", "left")
    if q:
        f = f.where(like(F.col("subject"), q) | like(F.col("metric"), q) | like(F.col("quote"), q))
    f = f.select("id", "doc_id", "subject", "metric", "value_raw", "unit_raw", "period_raw", "filename", "quote", "page_no")
    return f if limit is None or limit < 0 else f.orderBy("id").offset(offset).limit(limit)


def fact_detail(facts: DataFrame, documents: DataFrame, evidence: DataFrame, relations: DataFrame) -> DataFrame:
    """Each fact whole, with its filename, ``evidence`` (struct, null without) and ``relations`` (array of structs by id) (PRJ-4)."""
    e = evidence.where("fact_id is not null").groupBy(F.col("fact_id").alias("id")).agg(F.min_by(F.struct(*evidence.columns), "id").alias("evidence"))
    sides = relations.select(F.explode(F.array_distinct(F.array("fact_a", "fact_b"))).alias("fact"), F.struct(*relations.columns).alias("r")).where("fact is not null")
    r = sides.groupBy(F.col("fact").alias("id")).agg(F.array_sort(F.collect_set("r"), lambda x, y: F.when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0)).alias("relations"))
    f = facts.join(documents.select("doc_id", "filename"), "doc_id").join(e, "id", "left").join(r, "id", "left")
    return f.withColumn("relations", F.coalesce("relations", F.expr("cast(array() as " + r.schema["relations"].dataType.simpleString() + ")")))


def relations_listing(relations: DataFrame, facts: DataFrame, documents: DataFrame, verdict: str | None = None) -> DataFrame:
    """Relations with both facts side by side (JOIN-2, FLT-3, PRJ-2)."""
    side = facts.select("id", "doc_id", "subject", "metric", "value_raw", "unit_raw", "period_raw").join(documents.select("doc_id", "filename"), "doc_id")

    def of(p: str) -> DataFrame:
        return side.select(F.col("id").alias(f"fact_{p}"), F.col("subject").alias(f"{p}_subject"), F.col("metric").alias(f"{p}_metric"), F.col("value_raw").alias(f"{p}_value"),
                           F.col("unit_raw").alias(f"{p}_unit"), F.col("period_raw").alias(f"{p}_period"), F.col("filename").alias(f"{p}_doc"))

    r = relations.select("id", "fact_a", "fact_b", "final_verdict")
    if verdict:
        r = r.where(F.col("final_verdict") == verdict)
    return r.join(of("a"), "fact_a").join(of("b"), "fact_b")


def stats(documents: DataFrame, facts: DataFrame, evidence: DataFrame, relations: DataFrame, gaps: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row of counts (AGG-1): one pass a table, one-row frames side by side."""
    n = lambda df, c: df.agg(F.count("*").alias(c))
    parts = [n(documents, "documents"), facts.agg(F.count("*").alias("facts"), F.count_if(F.col("period_start").isNotNull()).alias("with_period")),
             evidence.agg(F.count_if(F.col("page_no").isNotNull()).alias("grounded_facts")), n(relations, "relations"), n(gaps, "gaps"), n(rejected, "rejected")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def verdict_counts(relations: DataFrame) -> DataFrame:
    """Relations by verdict, most frequent first (AGG-2, AGG-3, PRJ-7)."""
    return relations.groupBy(F.coalesce("final_verdict", F.lit("unclassified")).alias("verdict")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "verdict")


def case_report(relations: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row of counts below the chosen cases (REL-8): ungrounded and unread proposals, disputed and undecided pairs."""
    low = F.lower("reason")
    r = rejected.agg(F.count_if(low.contains("not found")).alias("ungrounded"), F.count_if(low.contains("no cached")).alias("unread"))
    return r.crossJoin(relations.agg(F.count_if(F.col("final_verdict") == "needs_review").alias("disputed"), F.count_if(F.col("final_verdict") == "insufficient_context").alias("undecided")))  # one row each


DIFF_TYPE = "map<string,struct<a:string,b:string>>"
TRANSFORM_TYPE = "struct<kind:string,factor:string>"


def decoded(relations: DataFrame) -> DataFrame:
    """Relations with qualifier_diff as a map and claimed_transform as a struct (PRJ-3); an empty or broken text gives an empty map and null."""
    out = relations.withColumn("qualifier_diff", F.coalesce(F.from_json("qualifier_diff", DIFF_TYPE), F.from_json(F.lit("{}"), DIFF_TYPE)))
    return out.withColumn("claimed_transform", F.from_json("claimed_transform", TRANSFORM_TYPE)) if "claimed_transform" in relations.columns else out


def relation_detail(relations: DataFrame, facts: DataFrame, documents: DataFrame, evidence: DataFrame) -> DataFrame:
    """Decoded relations with both facts whole, as ``a`` and ``b`` with filename and evidence (PRJ-5, JOIN-3)."""
    e = evidence.where("fact_id is not null").groupBy(F.col("fact_id").alias("id")).agg(F.min_by(F.struct(*evidence.columns), "id").alias("evidence"))
    side = facts.join(documents.select("doc_id", "filename"), "doc_id").join(e, "id", "left")
    of = lambda p: side.select(F.col("id").alias(f"fact_{p}"), F.struct(*side.columns).alias(p))
    return decoded(relations).join(of("a"), "fact_a").join(of("b"), "fact_b")


def rejected_kinds(rejected: DataFrame) -> DataFrame:
    """Counts of unread and ungrounded proposals (PRJ-6, AGG-4)."""
    kind = F.when(F.lower("reason").contains("no cached"), "unread").otherwise("ungrounded")
    return rejected.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def four_cases(relations: DataFrame, facts: DataFrame, k: int = 1) -> DataFrame:
    """``final_verdict, rank, id, is_cross, confidence``: the k best relations of each verdict (TOPK-1, REL-8).

    Rows across documents come first, same-document rows only where a verdict
    has no others; then by confidence (null is 0), then id.  The bound on the
    row number reaches below the shuffle, so a verdict with most of the rows
    sends k rows a task.
    """
    f = facts.select("id", "doc_id")
    r = relations.where("final_verdict is not null").join(f.select(F.col("id").alias("fact_a"), F.col("doc_id").alias("da")), "fact_a").join(f.select(F.col("id").alias("fact_b"), F.col("doc_id").alias("db")), "fact_b")
    r = r.select("final_verdict", "id", (F.col("da") != F.col("db")).alias("is_cross"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    w = Window.partitionBy("final_verdict").orderBy(F.desc("is_cross"), F.desc("confidence"), "id")
    out = r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    cross = out.groupBy("final_verdict").agg(F.max("is_cross").alias("any_cross"))
    return out.join(cross, "final_verdict").where("is_cross or not any_cross").select("final_verdict", "rank", "id", "is_cross", "confidence")


def display(relations: DataFrame) -> DataFrame:
    """``id, verdict, confidence``: as shown: spaces for underscores, two decimals (PRJ-8)."""
    return relations.select("id", F.replace(F.coalesce("final_verdict", F.lit("unclassified")), F.lit("_"), F.lit(" ")).alias("verdict"), F.format_number("confidence", 2).alias("confidence"))


def document_quality(documents: DataFrame, facts: DataFrame, rejected: DataFrame, gaps: DataFrame) -> DataFrame:
    """``doc_id, facts, dated, percent_dated, rejected, gaps`` of each document (AGG-5, AGG-12)."""
    f = facts.groupBy("doc_id").agg(F.count("*").alias("facts"), F.count_if(F.col("period_start").isNotNull()).alias("dated"))
    n = lambda df, c: df.groupBy("doc_id").agg(F.count("*").alias(c))
    d = documents.select("doc_id").join(f, "doc_id", "left").join(n(rejected, "rejected"), "doc_id", "left").join(n(gaps, "gaps"), "doc_id", "left").fillna(0)
    return d.select("doc_id", "facts", "dated", F.round(100.0 * F.col("dated") / F.greatest("facts", F.lit(1)), 4).alias("percent_dated"), "rejected", "gaps")


def by_id(df: DataFrame, key: str, value: object) -> DataFrame:
    """Point lookup; no row where there is none (FLT-4)."""
    return df.where(F.col(key) == F.lit(value))


def latest(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """Last n rows by an order; a bounded sort (SRT-3)."""
    return df.orderBy(F.desc(order)).limit(n)


def rejected_page(rejected: DataFrame, documents: DataFrame, n: int = 200) -> DataFrame:
    """First n rejected proposals whose quote was not found (JOIN-4, FLT-6, SRT-4)."""
    return rejected.where(F.lower("reason").contains("not found")).orderBy("evidence_id").limit(n).join(documents.select("doc_id", "filename"), "doc_id")


def gaps_page(gaps: DataFrame, documents: DataFrame) -> DataFrame:
    """Gaps with their filename in order of documents and pages (JOIN-4, SRT-2)."""
    return gaps.join(documents.select("doc_id", "filename"), "doc_id").orderBy("doc_id", "page_no")
