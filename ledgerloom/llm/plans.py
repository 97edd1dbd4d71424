"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, canonical, copies, groups, mixing, pieces, site_lines, stuffing
from ledgerloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_blocks(table(spark, d, "blocks"), table(spark, d, "documents"))


def p1_lines(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.line_report(table(spark, d, "blocks"), table(spark, d, "documents"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.clean_documents(table(spark, d, "blocks"), table(spark, d, "documents"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "windows"), table(spark, d, "blocks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.found_items(p2_pieces(spark, d))


def p2_covered(spark: SparkSession, d: str) -> DataFrame:
    """Each cut item put together again from its pieces without the repeats, and whether all pieces keep the bounds."""
    p = p2_pieces(spark, d)
    new = F.expr("substring(text, new_from - start + 1)")
    within = (F.length("text") <= pieces.MAX_CHARS) & (F.col("new_from") - F.col("start") <= pieces.OVERLAP)
    g = p.groupBy("item_kind", "item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", new.alias("new")))), lambda x: x["new"]), "").alias("text"), F.bool_and(within).alias("within"))
    return g.select("item_kind", "item_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("sha256"), "within")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.groups(groups.linked_pairs(table(spark, d, "relations")), unique=True)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "facts"), table(spark, d, "evidence"))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.all_records(table(spark, d, "facts"), table(spark, d, "evidence"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_names(table(spark, d, "facts"), table(spark, d, "canon_terms"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shards(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shard_counts(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_measures(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.page_measures(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents"))


QUERIES = {"p10_measures": p10_measures, "p1_found": p1_found, "p1_lines": p1_lines, "p1_clean": p1_clean, "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_covered": p2_covered, "p5_found": p5_found,
           "p6_found": p6_found, "p6_records": p6_records, "p7_found": p7_found, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_shards": p9_shards,
           "p10_found": p10_found}
_KEY = r"regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{Nd}}]+', '', 'g'), '\p{{Nd}}+', '0', 'g')"
_REPEATED = f"""
b as (
  select b.id, b.doc_id, b.text, d.source, {_KEY.format("b.text")} as k
  from blocks b join documents d on d.doc_id = b.doc_id where d.source is not null and regexp_matches(b.text, '[^\\s]')
),
n as (select source, count(distinct doc_id) as n from b group by 1),
f as (
  select b.source, b.k, count(distinct doc_id) as n_docs, any_value(n.n) as source_docs, arg_min(b.text, b.id) as line
  from b join n on n.source = b.source group by 1, 2 having count(distinct doc_id) >= 3 and 5 * count(distinct doc_id) >= any_value(n.n)
)
"""
ORACLE: dict[str, str] = {
    "p1_found": f"with {_REPEATED} select b.id as block_id from b join f on f.source = b.source and f.k = b.k",
    "p1_lines": f"with {_REPEATED} select source, line, n_docs, source_docs from f",
    "p1_clean": f"""
with {_REPEATED},
g as (select source, list(k) as ks from f group by 1),
l as (select d.doc_id, d.text, regexp_split_to_array(d.text, '\r\n|\r|\n') as lines, coalesce(g.ks, []) as ks from documents d left join g on g.source = d.source),
c as (select *, list_filter(lines, lambda x: not (regexp_matches(x, '[^\\s]') and list_contains(ks, {_KEY.format("x")}))) as kept from l)
select doc_id, case when len(kept) < len(lines) then array_to_string(kept, chr(10)) else text end as text, cast(coalesce(len(lines) - len(kept), 0) as bigint) as removed from c
""",
    "p2_found": "select 'window' as item_kind, id as item_id from windows where length(text) > 4000 union all select 'block', id from blocks where length(text) > 4000",
    "p2_covered": "select item_kind, item_id, cast(length(text) as bigint) as n_chars, sha256(text) as sha256, true as within from "
                  "(select 'window' as item_kind, id as item_id, text from windows union all select 'block', id, text from blocks) where length(text) > 4000",
    "p5_found": """
with recursive p as (
  select least(fact_a, fact_b) as a, greatest(fact_a, fact_b) as b, arg_max(coalesce(final_verdict, ''), id) as v from relations where fact_a <> fact_b group by 1, 2
),
e as (select a as x, b as y from p where v = 'corroborates' union select b, a from p where v = 'corroborates'),
r as (select x as fact_id, x as g from e union select e.y, r.g from r join e on e.x = r.fact_id)
select fact_id, min(g) as group_id from r group by 1
""",
}
