"""Model providers as a plug-in: prompts out, responses in, with rotation and waiting.

Without a provider the cache is the only source of responses.  A provider is
made on each executor by a factory and called as ``provider(prompt, key,
model)``; what it raises is sorted by :func:`sort_error`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import cache_key
from ledgerloom.operators.canon import with_ids
from ledgerloom.operators.grounding import probe_cache, summary
from ledgerloom.operators.reconcile import diff_json, is_rule_final
from ledgerloom.session import cut

# Markers in an error's type and message.
QUOTA_MARKS = ("429", "rate limit", "resource_exhausted", "resourceexhausted", "quota", "exhausted")
RETRY_MARKS = ("503", "unavailable", "500", "internal", "deadline", "timeout", "connection")


def sort_error(error: Exception) -> str:
    """quota: this key and model are spent; retry: worth waiting out; fatal: neither (SCL-36)."""
    text = f"{type(error).__name__} {error}".lower()
    for kind, marks in (("quota", QUOTA_MARKS), ("retry", RETRY_MARKS)):
        if any(m in text for m in marks):
            return kind
    return "fatal"


def call(provider: Callable[[str, str, str], str], prompt: str, ways: list[tuple[str, str]], spent: set[tuple[str, str]],
         attempts: int = 4, wait: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, str | None]:
    """``(model, response, error)`` of one prompt; spent ways are remembered for the next (SEQ-10)."""
    error: Exception | None = None
    for way in ways:
        if way in spent:
            continue
        for n in range(attempts):
            try:
                return way[1], provider(prompt, *way), None
            except Exception as e:  # noqa: BLE001 - whatever a provider raises is sorted
                error, kind = e, sort_error(e)
                if kind == "quota":
                    spent.add(way)
                    break
                if kind == "fatal" or n == attempts - 1:
                    return None, None, f"{type(e).__name__}: {e}"
                wait(min(2.0 ** (n + 1), 60.0))
    return None, None, f"every key and model is spent: {error}"


def complete(prompts: DataFrame, cache: DataFrame, factory: Callable[[], Callable[[str, str, str], str]], keys: list[str], models: list[str], version: str) -> DataFrame:
    """``id, key, response, error`` of the prompts the cache does not answer; the key is the cache's."""
    open_ = prompts.join(probe_cache(prompts, cache, models, version).where("response is null").select("id"), "id", "left_semi")
    ways = [(k, m) for k in keys for m in models]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, spent = factory(), set()
        for b in batches:
            rows = [(i, p, *call(provider, p, ways, spent)) for i, p in zip(b["id"], b["prompt"])]
            yield pd.DataFrame(rows, columns=["id", "prompt", "model", "response", "error"])

    done = open_.select("id", "prompt").mapInPandas(run, f"id {prompts.schema['id'].dataType.simpleString()}, prompt string, model string, response string, error string")
    return done.select("id", F.when(F.col("model").isNotNull(), cache_key(F.col("model"), F.lit(version), F.col("prompt"))).alias("key"), "response", "error")


def fill(template: str, **parts: Column) -> Column:
    """A prompt from a template with {name} places (SCL-11); null parts read as "none"."""
    out = F.lit(template)
    for name, c in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("none")))
    return out


def extraction_prompts(windows: DataFrame, template: str) -> DataFrame:
    """``id, prompt`` of each window: the template with its text in {window} (SCL-11)."""
    return windows.select("id", fill(template, window=F.col("text")).alias("prompt"))


def adjudication_prompts(classified: DataFrame, facts: DataFrame, evidence: DataFrame, documents: DataFrame, template: str) -> DataFrame:
    """``fact_a, fact_b, prompt`` of the pairs a model would be asked about (SCL-11).

    Places of the template: {a}, {b} (summaries), {a_quote}, {b_quote}, {a_doc},
    {b_doc}, {a_page}, {b_page}, {diff} (JSON) and {agree_text}.
    """
    quote = evidence.where("fact_id is not null").groupBy(F.col("fact_id").alias("id")).agg(F.min_by(F.struct("quote", "page_no"), "id").alias("e"))
    side = summary(facts).join(facts.select("id", "doc_id"), "id").join(documents.select("doc_id", "filename"), "doc_id").join(quote, "id", "left")
    of = lambda p: side.select(F.col("id").alias(f"fact_{p}"), F.col("summary").alias(f"s_{p}"), F.coalesce("e.quote", F.lit("")).alias(f"q_{p}"), F.col("filename").alias(f"d_{p}"), F.col("e.page_no").alias(f"p_{p}"))
    # cut before the filter, which would otherwise repeat all steps to the verdict
    asked = cut(classified.select("fact_a", "fact_b", "rule_verdict", "agree", diff_json(F.col("differs")).alias("diff"))).where(~is_rule_final(F.col("rule_verdict")))
    j = asked.join(of("a"), "fact_a").join(of("b"), "fact_b")
    agree = F.when(F.col("agree"), "agree").otherwise("differ")
    return j.select("fact_a", "fact_b", fill(template, a_quote=F.col("q_a"), b_quote=F.col("q_b"), a_doc=F.col("d_a"), b_doc=F.col("d_b"), a_page=F.col("p_a"), b_page=F.col("p_b"),
                                             diff=F.col("diff"), agree_text=agree, a=F.col("s_a"), b=F.col("s_b")).alias("prompt"))


def term_prompts(terms: DataFrame, known: DataFrame, template: str, terms_per_prompt: int = 500) -> DataFrame:
    """``id, kind, prompt``: names to be grouped, in sorted lists of bounded length, beside the known groups of their kind."""
    per = F.expr(f"n div {terms_per_prompt}")
    from pyspark.sql.window import Window

    t = terms.where("raw is not null and raw != ''").select("kind", "raw").distinct().join(known.select("kind", "raw").distinct(), ["kind", "raw"], "left_anti")
    t = t.withColumn("bucket", F.pmod(F.xxhash64("raw"), F.lit(64))).withColumn("n", F.row_number().over(Window.partitionBy("kind", "bucket").orderBy("raw")) - 1).withColumn("part", per)
    lists = t.groupBy("kind", "bucket", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("raw")), lambda x: F.concat(F.lit("- "), x)), "\n").alias("terms"))
    groups = known.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(": ", F.lit("-"), "canon_id", "label"))), "\n").alias("groups"))
    j = lists.join(groups, "kind", "left")
    return j.select(F.concat_ws("/", "kind", "bucket", "part").alias("id"), "kind", fill(template, kind=F.col("kind"), terms=F.col("terms"), existing=F.coalesce("groups", F.lit("(none yet)"))).alias("prompt"))


def assign_groups(terms: DataFrame, known: DataFrame, groups: DataFrame) -> DataFrame:
    """``kind, raw, canon_id, label``: known terms keep theirs, answered ones get their group (the last wins), dropped ones their slug (SEQ-7).

    groups holds ``kind, seq, canon_id, label, members``.
    """
    from ledgerloom.functions.text import slug

    k = known.groupBy("kind", "raw").agg(F.min(F.struct("canon_id", "label")).alias("k"))
    g = groups.where("canon_id is not null").select("kind", "seq", "canon_id", F.coalesce("label", F.lit("")).alias("label"), F.explode("members").alias("raw"))
    g = g.groupBy("kind", "raw").agg(F.max_by(F.struct("canon_id", "label"), "seq").alias("g"))
    t = terms.where("raw is not null and raw != ''").select("kind", "raw").distinct().join(k, ["kind", "raw"], "left").join(g, ["kind", "raw"], "left")
    pick = F.coalesce("k", "g", F.struct(slug(F.col("raw")).alias("canon_id"), F.col("raw").alias("label")))
    return t.select("kind", "raw", pick["canon_id"].alias("canon_id"), pick["label"].alias("label"))


def canonicalise_corpus(facts: DataFrame, known: DataFrame, cache: DataFrame, models: list[str], template: str, version: str = "canon-v1") -> tuple[DataFrame, DataFrame]:
    """``kind, raw, canon_id, label`` of all terms, and ``id, entity_id, metric_id`` of all facts (SEQ-8).

    One pass over the distinct terms: known ones keep their id, the others are
    asked for in lists of bounded length, what the cache answers is grouped, and
    the rest gets its slug.
    """
    long = facts.select(F.explode(F.array(F.struct(F.lit("subject").alias("kind"), F.col("subject").alias("raw")), F.struct(F.lit("metric").alias("kind"), F.col("metric").alias("raw")))).alias("x"))
    terms = cut(long.select("x.kind", "x.raw").where("raw is not null and raw != ''").distinct())
    prompts = cut(term_prompts(terms, known, template))
    answered = prompts.join(probe_cache(prompts.select("id", "prompt"), cache, models, version), "id").where("response is not null")
    shape = "struct<groups:array<struct<canon_id:string,label:string,members:array<string>>>>"
    g = answered.select("kind", F.col("id").alias("list"), F.posexplode(F.from_json("response", shape)["groups"]).alias("seq", "g"))
    groups = g.select("kind", F.struct("list", "seq").alias("seq"), "g.canon_id", "g.label", "g.members")
    out = cut(assign_groups(terms, known, groups))
    return out, with_ids(facts, out)
