"""Claims that are copies but for formatting (problem 6).

Canonical keys are counted exactly, with partial counts before the shuffle.
Keys with more rows than a threshold are hot: their rows are salted and
aggregated in two levels, by (key, salt) and by key, and meet their group
through (key, salt); all others are aggregated and meet their group through
one shuffle by key.  The smallest fact id of a group represents it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.keys import content_tokens, hash128
from ledgerloom.session import cut

#: Rows of one key from which it is salted.
HOT_ROWS = 1_000
#: At most so many keys can be hot, so their list may be broadcast: the threshold rises with the row count.
MAX_HOT = 10_000
SALTS = 64
_KEY = ["k1", "k2"]


#: Stands between fields; no field holds this mark twice in a row.
_BETWEEN = " € € "


def keyed_claims(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """``fact_id, k1, k2``: document, subject, metric, value and quote in canonical form.

    The quote's words and numbers count as a bag, so the order of listed fields
    does not matter.  Only hashes are shuffled.
    """
    q1, q2 = hash128(F.array_join(F.array_sort(content_tokens(F.col("quote"), grouped=True)), " "))
    e = (evidence.where("fact_id is not null and quote is not null").select("fact_id", "quote")
         .select("fact_id", q1.alias("q1"), q2.alias("q2")).distinct())
    # one pass over the fields together
    fields = F.concat_ws(_BETWEEN, *[F.coalesce(F.col(c), F.lit("")) for c in ("subject", "metric", "value_raw")])
    f1, f2 = hash128(F.col("doc_id"), F.array_join(content_tokens(fields), " "))
    f = facts.where("id is not null").select(F.col("id").alias("fact_id"), f1.alias("f1"), f2.alias("f2"))
    k1, k2 = hash128(F.col("f1"), F.col("q1"), F.col("f2"), F.col("q2"))
    # the join's partitioning serves the distinct, so repeated rows go without a shuffle
    return f.join(e, "fact_id").select("fact_id", k1.alias("k1"), k2.alias("k2")).distinct()


def hot_keys(claims: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``k1, k2, hot`` of the keys with more rows than the threshold, counted exactly."""
    most = max(hot_rows, claims.count() // MAX_HOT)
    return claims.groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*_KEY, F.lit(True).alias("hot"))


def salted(claims: DataFrame, hot: DataFrame) -> DataFrame:
    """claims with ``salt``: 0 to SALTS - 1 for rows of hot keys, null for others."""
    return claims.join(F.broadcast(hot), _KEY, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.hash("fact_id"), F.lit(SALTS)))).drop("hot")


def claim_groups(rows: DataFrame) -> DataFrame:
    """``k1, k2, n, first_id, hot`` of every claim: hot keys in two levels, the others in one."""
    cold = rows.where("salt is null").groupBy(*_KEY).agg(F.count("*").alias("n"), F.min("fact_id").alias("first_id"))
    part = rows.where("salt is not null").groupBy(*_KEY, "salt").agg(F.count("*").alias("n"), F.min("fact_id").alias("first_id"))
    both = part.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
    return cold.withColumn("hot", F.lit(False)).unionByName(both.withColumn("hot", F.lit(True)))


def copies(facts: DataFrame, evidence: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``first_id, fact_id``: each copy but the first with the smallest id of its group.

    Facts without evidence or with a null quote are no copies.  Null subject,
    metric or value equals an empty one.  Repeated evidence rows count once; a
    fact with several different quotes is a copy where any of them agrees.
    """
    claims = cut(keyed_claims(facts, evidence))
    hot = cut(hot_keys(claims, hot_rows))
    rows = salted(claims, hot)
    groups = claim_groups(rows).where("n > 1")
    met = rows.where("salt is null").drop("salt").join(groups.where("not hot"), _KEY).select("first_id", "fact_id")
    if not hot.isEmpty():
        groups = cut(groups)
        spread = groups.where("hot").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = met.unionByName(rows.where("salt is not null").join(spread.hint("merge"), [*_KEY, "salt"]).select("first_id", "fact_id"))
    return met.where("fact_id != first_id").distinct()


def claim_records(facts: DataFrame, evidence: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``first_id, copies``: one record per claim with evidence, with the number of its copies (1: no other)."""
    claims = cut(keyed_claims(facts, evidence))
    return claim_groups(salted(claims, hot_keys(claims, hot_rows))).groupBy("first_id").agg(F.max("n").alias("copies"))


def all_records(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """``first_id, copies``: ``claim_records``, and each fact without a quote as a record of its own.

    A fact without evidence or with null quotes only is no copy of another, so
    its copies are 1; a repeated row counts once, a null id is no fact.
    """
    quoted = evidence.where("quote is not null").select(F.col("fact_id").alias("first_id"))
    bare = facts.where("id is not null").select(F.col("id").alias("first_id")).join(quoted, "first_id", "left_anti").distinct()
    return claim_records(facts, evidence).unionByName(bare.withColumn("copies", F.lit(1).cast("bigint")))
