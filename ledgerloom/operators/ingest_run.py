"""Documents to facts and evidence: the ingest from texts to tables (SNK-2 to SNK-5, SEQ-4 to SEQ-6).

Every table is a DataFrame that the caller writes; ids follow from positions,
so a run repeated on the same input gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.periods import with_printed_period
from ledgerloom.functions.text import collapse, locate, slug
from ledgerloom.functions.values import with_canonical_pair
from ledgerloom.operators import grounding, ingest
from ledgerloom.session import cut
from ledgerloom.sources.sinks import cascade_delete, insert_or_get
from ledgerloom.sources.texts import text_blocks

#: Low bits of an id that number the rows within their document.
WITHIN_BITS = 28


def within(doc_id: Column, n: Column) -> Column:
    """Id of the n-th row (from 0) of a document: in order of documents, then of n."""
    return F.shiftleft(doc_id, WITHIN_BITS) + n


def block_rows(documents: DataFrame) -> DataFrame:
    """``id, doc_id, page_no, block_index, text, is_boilerplate`` of the texts' blocks, furniture flagged (SNK-2).

    Ids rise in reading order; null texts have no blocks.
    """
    b = text_blocks(documents)
    b = b.withColumn("id", within(F.col("doc_id"), (F.col("page_no") - 1) * 40 + F.col("block_index")))
    return b.join(ingest.flag_boilerplate(b), ["id", "doc_id"]).select("id", "doc_id", "page_no", "block_index", "text", "is_boilerplate")


def window_rows(blocks: DataFrame, max_windows: int | None = None) -> DataFrame:
    """Windows with ids; at most so many of a document, the densest (AGG-14)."""
    w = ingest.build_windows(blocks)
    if max_windows is not None:
        w = ingest.densest(w, max_windows)
    return w.withColumn("id", within(F.col("doc_id"), F.col("window_index")))


def grounded(proposals: DataFrame, windows: DataFrame) -> DataFrame:
    """Proposals with the text they come from, ``at`` (struct start, end; null where the quote does not stand in it) and ``reason``.

    The quote's reason wins over missing names (FLT-10); a half is read in its
    own text and placed in the window's.
    """
    half = ingest.halves(windows).select("window_id", (F.col("window_index") % 10).alias("half"), "text", "block_ids", "block_spans")
    whole = windows.select(F.col("id").alias("window_id"), F.lit(-1).alias("half"), "text", "block_ids", "block_spans")
    order = windows.select(F.col("id").alias("window_id"), "window_index", "density")
    p = proposals.join(whole.unionByName(half), ["window_id", "half"]).join(order, "window_id").withColumn("at", locate(F.col("text"), F.col("evidence_quote")))
    empty = (F.coalesce("subject", F.lit("")) == "") | (F.coalesce("metric", F.lit("")) == "")
    return p.withColumn("reason", F.when(F.col("at").isNull(), grounding.NOT_FOUND).when(empty, grounding.MISSING))


def rejected_rows(read: DataFrame, lost: DataFrame) -> DataFrame:
    """``doc_id, payload, reason``: proposals that are not grounded, and windows that were not read (SNK-4)."""
    fields = F.to_json(F.struct("subject", "metric", "value_raw", "unit_raw", "period_raw", "qualifiers", "claim_type", "evidence_quote", "confidence"))
    bad = read.where("reason is not null").select("doc_id", fields.alias("payload"), "reason")
    return bad.unionByName(lost.select("doc_id", F.to_json(F.struct("window_id", "half")).alias("payload"), "reason"))


def fact_rows(read: DataFrame, terms: DataFrame) -> DataFrame:
    """Accepted proposals, one per claim, normalised and with ids: the columns of facts and those of their evidence (AGG-10, SNK-9).

    Of claims alike but for case and white space the most confident stays, then
    the first: documents are read densest window first.  Names take their
    canonical id from terms, else their slug.
    """
    key = [F.col("doc_id"), grounding.dedupe_key("subject"), grounding.dedupe_key("metric"), F.trim(F.coalesce("value_raw", F.lit(""))),
           F.trim(F.coalesce("period_raw", F.lit(""))), F.lower(collapse(F.coalesce("evidence_quote", F.lit(""))))]
    order = [F.desc("density"), F.col("window_index"), F.col("half"), F.col("seq")]
    ok = read.where("reason is null").withColumns({"k1": F.xxhash64(*key), "k2": F.xxhash64(F.lit("second"), *key)})
    best = Window.partitionBy("doc_id", "k1", "k2").orderBy(F.desc("confidence"), *order)
    f = ok.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "k1", "k2")
    f = f.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)
    f = with_printed_period(with_canonical_pair(f, "value_raw", "unit_raw", "evidence_quote"), "period_raw")
    f = f.select(within(F.col("doc_id"), F.col("n")).alias("id"), "doc_id", "subject", "metric", "value_raw", "unit_raw", "period_raw", "qualifiers", "claim_type", "confidence",
                 "canon_value", "canon_unit", "period_start", "period_end", "period_kind",
                 "evidence_quote", "at", "block_ids", "block_spans")
    for name, kind_ in (("entity_id", "subject"), ("metric_id", "metric")):
        t = terms.where(F.col("kind") == kind_).groupBy(F.col("raw").alias(kind_)).agg(F.min("canon_id").alias(name))
        f = f.join(t, kind_, "left").withColumn(name, F.coalesce(name, slug(F.col(kind_))))
    return f


_FACT = ("id", "doc_id", "subject", "metric", "value_raw", "unit_raw", "period_raw", "qualifiers", "claim_type", "confidence", "canon_value", "canon_unit",
         "period_start", "period_end", "period_kind", "entity_id", "metric_id")


def evidence_rows(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """``fact_id, quote, page_no, char_start, char_end, block_ids, x0, y0, x1, y1``: where each fact's quote stands (SNK-3, SCL-30, SCL-31)."""
    z = F.arrays_zip(F.col("block_spans").alias("span"), F.col("block_ids").alias("bid"))
    over = F.transform(F.filter(z, lambda x: (F.col("at.start") < x["span"]["e"]) & (F.col("at.end") > x["span"]["s"])), lambda x: x["bid"])
    e = facts.select(F.col("id").alias("fact_id"), F.col("evidence_quote").alias("quote"), F.col("at.start").alias("char_start"), F.col("at.end").alias("char_end"),
                     F.coalesce(over, F.array().cast("array<bigint>")).alias("block_ids"))
    box = [c if c in blocks.columns else F.lit(None).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    boxes = grounding.evidence_boxes(e.select(F.col("fact_id").alias("id"), "block_ids"), blocks.select("id", "page_no", *box))
    return e.join(boxes.withColumnRenamed("evidence_id", "fact_id"), "fact_id", "left").select(
        "fact_id", "quote", "page_no", "char_start", "char_end", "block_ids", "x0", "y0", "x1", "y1")


def read_windows(windows: DataFrame, blocks: DataFrame, cache: DataFrame, models: list[str], terms: DataFrame, version: str = "extract-v1") -> dict[str, DataFrame]:
    """``facts``, ``evidence``, ``rejected`` of windows whose responses stand in a cache."""
    proposals, lost = grounding.extract(windows, cache, models, version)
    read = cut(grounded(proposals, windows))
    facts = cut(fact_rows(read, terms))
    return {"facts": facts.select(*_FACT), "evidence": evidence_rows(facts, blocks), "rejected": rejected_rows(read, lost)}


def run(documents: DataFrame, cache: DataFrame, models: list[str], terms: DataFrame, max_windows: int | None = None, version: str = "extract-v1") -> dict[str, DataFrame]:
    """All tables of new documents ``doc_id, text, page_count, sha256``: documents, blocks, gaps, facts, evidence, rejected.

    Of documents of one content the first counts (SNK-1).  A document is
    complete only if all its windows were read (SEQ-5).
    """
    first = insert_or_get(documents).select("doc_id")
    docs = documents.join(first, "doc_id", "left_semi")
    blocks = cut(block_rows(docs))
    windows = cut(window_rows(blocks, max_windows))
    out = read_windows(windows, blocks, cache, models, terms, version)
    done = grounding.completed(docs, out["rejected"])
    return out | {"documents": docs.join(done, "doc_id"), "blocks": blocks, "gaps": ingest.page_gaps(docs, blocks)}


def rerun(store: dict[str, DataFrame], documents: DataFrame, cache: DataFrame, models: list[str], terms: DataFrame, **how: object) -> dict[str, DataFrame]:
    """The store after documents arrive (again): complete contents are left alone, incomplete ones cleared and redone (SEQ-6)."""
    todo = cut(grounding.to_ingest(documents, store["documents"]))
    # what is left of an earlier, incomplete attempt at the same contents
    old = store["documents"].join(todo.select("sha256").distinct(), "sha256", "left_semi").select("doc_id")
    kept = cascade_delete(old, **{k: store[k] for k in ("facts", "evidence", "relations", "blocks", "gaps", "rejected")})
    kept["documents"] = store["documents"].join(old, "doc_id", "left_anti")
    new = run(todo, cache, models, terms, **how)
    return {k: v.unionByName(new[k], allowMissingColumns=True) if k in new else v for k, v in kept.items()}
