"""Proposals to evidence: cache probe, grounding, dedupe, boxes, audit."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import cache_key, collapse, locate
from ledgerloom.operators.ingest import halves
from ledgerloom.session import cut

NOT_FOUND = "evidence_quote not found in source window"
MISSING = "missing subject or metric"


def quoted_texts(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """``evidence_id, fact_id, quote, text``: each quote with its blocks' text, joined by newlines in id order (JOIN-15)."""
    e = evidence.select(F.col("id").alias("evidence_id"), F.explode_outer("block_ids").alias("bid"))
    t = (e.join(blocks.select(F.col("id").alias("bid"), F.col("text").alias("t")), "bid")
         .groupBy("evidence_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("bid", "t"))), lambda x: x["t"]), "\n").alias("text")))
    return evidence.select(F.col("id").alias("evidence_id"), "fact_id", "quote").join(t, "evidence_id", "left")


def ground(quoted: DataFrame) -> DataFrame:
    """``evidence_id, fact_id, start, end`` of quotes that stand in their text (SCL-3)."""
    g = quoted.withColumn("at", locate(F.col("text"), F.col("quote"))).where("at is not null")
    return g.select("evidence_id", "fact_id", F.col("at.start").alias("start"), F.col("at.end").alias("end"))


def rejected(quoted: DataFrame, facts: DataFrame) -> DataFrame:
    """``evidence_id, fact_id, reason``; the quote's reason wins over missing names (FLT-10)."""
    f = facts.select(F.col("id").alias("fact_id"), "subject", "metric")
    q = quoted.join(f, "fact_id").withColumn("at", locate(F.col("text"), F.col("quote")))
    empty = (F.coalesce("subject", F.lit("")) == "") | (F.coalesce("metric", F.lit("")) == "")
    reason = F.when(F.col("at").isNull(), NOT_FOUND).when(empty, MISSING)
    return q.select("evidence_id", "fact_id", reason.alias("reason")).where("reason is not null")


def dedupe_key(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def dedupe_facts(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """``fact_id, confidence, copies``: of facts alike but for case and white space the most confident, then the first (AGG-10).

    One aggregate with a partial phase; a hot key combines before the shuffle.
    Null confidence counts as zero, null text as empty.
    """
    e = evidence.where("fact_id is not null").groupBy("fact_id").agg(F.min("quote").alias("quote"))
    f = facts.join(e.withColumnRenamed("fact_id", "id"), "id", "left")
    key = [F.col("doc_id"), dedupe_key("subject"), dedupe_key("metric"), F.trim(F.coalesce("value_raw", F.lit(""))),
           F.trim(F.coalesce("period_raw", F.lit(""))), F.lower(collapse(F.coalesce("quote", F.lit(""))))]
    best = F.max_by("id", F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("id")))
    g = f.groupBy(F.xxhash64(*key).alias("k1"), F.xxhash64(F.lit("second"), *key).alias("k2")).agg(
        best.alias("fact_id"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.count("*").alias("copies"))
    return g.select("fact_id", "confidence", "copies")


def evidence_boxes(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """``evidence_id, page_no, x0, y0, x1, y1``: page of the lowest block, hull of the blocks on it (AGG-8, SCL-31)."""
    e = evidence.select(F.col("id").alias("evidence_id"), F.explode("block_ids").alias("bid")).distinct()
    j = e.join(blocks.select(F.col("id").alias("bid"), "page_no", "x0", "y0", "x1", "y1"), "bid")
    page = j.groupBy("evidence_id").agg(F.min_by("page_no", "bid").alias("first_page"))
    hull = j.groupBy("evidence_id", "page_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return page.join(hull, "evidence_id").where("page_no = first_page").select("evidence_id", "page_no", "x0", "y0", "x1", "y1")


def audit(evidence: DataFrame, blocks: DataFrame, facts: DataFrame) -> DataFrame:
    """``fact_id, evidence_id, status``: checked on its page, straddling (only in its blocks), failure, or unplaced (REL-7).

    Only white space is evened out, case counts.  Pages are gathered only as
    far as a quote names them.
    """
    e = (evidence.join(facts.select(F.col("id").alias("fact_id"), "doc_id"), "fact_id")
         .select(F.col("id").alias("evidence_id"), "fact_id", "doc_id", "page_no", "block_ids", collapse(F.col("quote")).alias("needle")))
    pages = (blocks.join(e.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_semi").groupBy("doc_id", "page_no")
             .agg(collapse(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "id", "text"))), lambda x: x["text"]), " ")).alias("page_text")))
    named = (e.select("evidence_id", F.explode("block_ids").alias("bid")).join(blocks.select(F.col("id").alias("bid"), F.col("text").alias("t")), "bid")
             .groupBy("evidence_id").agg(collapse(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("bid", "t"))), lambda x: x["t"]), " ")).alias("named_text")))
    j = e.join(pages, ["doc_id", "page_no"], "left").join(named, "evidence_id", "left")
    status = (F.when(F.col("page_no").isNull(), "unplaced").when(F.contains("page_text", "needle"), "checked")
              .when(F.contains("named_text", "needle"), "straddling").otherwise("failure"))
    return j.select("fact_id", "evidence_id", status.alias("status"))


def probe_cache(prompts: DataFrame, cache: DataFrame, models: list[str], version: str) -> DataFrame:
    """``id, response``: the first hit in model order, null without one (JOIN-13)."""
    m = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(x).alias("model")) for i, x in enumerate(models)])
    p = prompts.select("id", "prompt", F.explode(m).alias("m")).select("id", "m.ord", cache_key(F.col("m.model"), F.lit(version), F.col("prompt")).alias("key"))
    hit = p.join(cache.select("key", "response"), "key").groupBy("id").agg(F.min_by("response", "ord").alias("response"))
    return prompts.select("id").join(hit, "id", "left")


def lenient_json(text: str | None) -> str | None:
    """The first usable JSON object of a response; several envelopes are merged (SCL-34, SCL-35)."""
    if not text:
        return None
    values, at, decoder = [], 0, json.JSONDecoder()
    try:
        values = [json.loads(text)]
    except ValueError:
        while (at := min((k for k in (text.find("{", at), text.find("[", at)) if k >= 0), default=-1)) >= 0:
            try:
                v, at = decoder.raw_decode(text, at)
                values.append(v)
            except ValueError:
                at += 1
    dicts = [x for v in values for x in (v if isinstance(v, list) else [v]) if isinstance(x, dict)]
    if len(values) > 1 or len(dicts) > 1:
        dicts = [d for d in dicts if any(isinstance(x, list) for x in d.values())] or dicts[:1]
    if not dicts:
        return None
    out: dict = {}
    for d in dicts:
        for k, v in d.items():
            if isinstance(v, list) and isinstance(out.get(k), list):
                out[k] = out[k] + v
            else:
                out.setdefault(k, v)
    return json.dumps(out)


def scalar_text(v: object) -> str | None:
    """A JSON scalar as text: floats with six significant digits; lists and objects are no text (SCL-4)."""
    if v is None or isinstance(v, (list, dict)):
        return None
    return f"{v:g}" if isinstance(v, float) else str(v)


_TEXTS = ("subject", "metric", "value_raw", "unit_raw", "period_raw", "claim_type", "evidence_quote")
_PROPOSAL = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in _TEXTS]
                                     + [T.StructField("qualifiers", T.MapType(T.StringType(), T.StringType())), T.StructField("confidence", T.DoubleType())]))


def _proposals(response: str | None) -> list[dict] | None:
    whole = lenient_json(response)
    if whole is None:
        return None
    out = []
    for f in json.loads(whole).get("facts") or []:
        if not isinstance(f, dict):
            continue
        row: dict = {c: scalar_text(f.get(c)) for c in _TEXTS}
        q = f.get("qualifiers")
        row["qualifiers"] = {k: t for k, v in q.items() if (t := scalar_text(v)) is not None} if isinstance(q, dict) else {}
        row["claim_type"] = row["claim_type"] or "measurement"
        try:
            row["confidence"] = float(f.get("confidence") or 0)
        except (TypeError, ValueError):
            row["confidence"] = 0.0
        out.append(row)
    return out


@F.pandas_udf(_PROPOSAL)
def parse_response(response: pd.Series) -> pd.Series:
    """Proposed facts of each response; null where it is missing or unusable."""
    return response.map(_proposals, na_action="ignore")


def explode_proposals(responses: DataFrame) -> DataFrame:
    """``id, seq`` and the fields of each proposed fact; confidence that is no number is 0 (SCL-37)."""
    p = responses.select("id", F.posexplode(parse_response("response")).alias("seq", "f"))
    return p.select("id", "seq", *[F.col(f"f.{c}") for c in (*_TEXTS, "qualifiers", "confidence")])


UNREAD = "no cached response and no API key"
UNUSABLE = "unusable model output"


def extract(windows: DataFrame, cache: DataFrame, models: list[str], version: str = "extract-v1") -> tuple[DataFrame, DataFrame]:
    """Proposals ``doc_id, window_id, half, seq, ...`` and rejected ``doc_id, window_id, half, reason`` (SEQ-4).

    A window without a cached response is skipped; one whose response cannot be
    used is halved once and its halves are probed; half -1 stands for the whole.
    """
    whole = windows.select(F.col("id").alias("window_id"), F.lit(-1).alias("half"), "doc_id", F.col("text").alias("prompt"))

    def probed(df: DataFrame) -> DataFrame:
        q = df.withColumn("id", F.struct("window_id", "half"))
        r = probe_cache(q.select("id", "prompt"), cache, models, version)
        return q.join(r, "id").withColumn("facts", parse_response("response"))

    first = cut(probed(whole))
    bad = first.where("response is not null and facts is null").select(F.col("window_id").alias("id"))
    parts = halves(windows.join(bad, "id", "left_semi")).select("window_id", (F.col("window_index") % 10).alias("half"), F.col("text").alias("prompt"))
    second = cut(probed(parts.join(windows.select(F.col("id").alias("window_id"), "doc_id"), "window_id").select(*whole.columns)))
    split = parts.select("window_id").distinct()
    done = first.where("facts is not null").unionByName(second.where("facts is not null"))
    lost = first.where("facts is null").join(split, "window_id", "left_anti").unionByName(second.where("facts is null"))
    f = done.select("doc_id", "window_id", "half", F.posexplode("facts").alias("seq", "f"))
    return (f.select("doc_id", "window_id", "half", "seq", *[F.col(f"f.{c}") for c in (*_TEXTS, "qualifiers", "confidence")]),
            lost.select("doc_id", "window_id", "half", F.when(F.col("response").isNull(), UNREAD).otherwise(UNUSABLE).alias("reason")))


def completed(documents: DataFrame, rejected_rows: DataFrame) -> DataFrame:
    """``doc_id, ingest_complete``: complete only if nothing was skipped (SEQ-5)."""
    skipped = rejected_rows.where(F.col("reason").contains("no cached")).select("doc_id").distinct().withColumn("skipped", F.lit(True))
    return documents.select("doc_id").join(skipped, "doc_id", "left").select("doc_id", F.col("skipped").isNull().alias("ingest_complete"))


def to_ingest(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose content is not complete yet; complete ones are left alone (SEQ-6)."""
    return documents.join(known.where("ingest_complete").select("sha256").distinct(), "sha256", "left_anti").select(*documents.columns)


def summary(facts: DataFrame) -> DataFrame:
    """``id, summary``: subject | metric | value unit | period X | sorted JSON qualifiers, empty parts dropped (SCL-10)."""
    full = lambda c: F.nullif(collapse(c), F.lit(""))
    value = full(F.concat_ws(" ", full(F.col("value_raw")), full(F.col("unit_raw"))))
    q = F.when(F.size("qualifiers") > 0, F.to_json(F.map_from_entries(F.array_sort(F.map_entries("qualifiers")))))
    return facts.select("id", F.concat_ws(" | ", full(F.col("subject")), full(F.col("metric")), value, F.concat(F.lit("period "), full(F.col("period_raw"))), q).alias("summary"))
