"""Facts worth comparing: blocking, similarity join, capped selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.graphs import components
from ledgerloom.functions.text import metric_tokens
from ledgerloom.functions.values import units_compatible
from ledgerloom.session import Scratch, cut

MIN_JACCARD = 0.6
MAX_PAIRS = 6
#: Facts of one rank bucket of a metric (see capped_uniform).
BUCKET_BITS = 16


def metric_pair_counts(facts: DataFrame) -> DataFrame:
    """``metric_id, facts, pairs``: comparable pairs of each metric, counted without building them (JOIN-7, JOIN-9).

    A pair is comparable unless both units are known and differ, so the number
    follows from the sizes of the unit classes.  Facts without a metric id pair
    with none.
    """
    unit = F.nullif(F.nullif("canon_unit", F.lit("")), F.lit("UNKNOWN"))
    c = facts.where("metric_id is not null and metric_id != ''").groupBy("metric_id", unit.alias("unit")).agg(F.count("*").alias("n"))
    s = c.groupBy("metric_id").agg(F.sum("n").alias("facts"), F.sum(F.when(F.col("unit").isNotNull(), F.col("n"))).alias("known"),
                                   F.sum(F.when(F.col("unit").isNotNull(), F.col("n") * F.col("n"))).alias("squares"))
    every = F.expr("facts * (facts - 1) div 2")
    apart = F.expr("(coalesce(known, 0) * coalesce(known, 0) - coalesce(squares, 0)) div 2")
    return s.select("metric_id", "facts", (every - apart).alias("pairs"))


def token_sets(facts: DataFrame) -> DataFrame:
    """``key, tokens, facts``: distinct token sets of the metrics; empty sets are left out."""
    t = facts.where("metric is not null").groupBy("metric").agg(F.count("*").alias("n"))
    t = t.withColumn("tokens", F.array_sort(metric_tokens(F.col("metric")))).where("size(tokens) > 0")
    return t.groupBy("tokens").agg(F.sum("n").alias("facts")).withColumn("key", F.array_join("tokens", " "))


def similar_sets(sets: DataFrame, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """``key_a, key_b, common, total`` of token sets alike enough (JOIN-8).

    Prefix filtering: tokens are ordered by rarity, and two sets can only reach
    the threshold if their rarest ``n - ceil(t n) + 1`` tokens meet, so a
    frequent token never joins everything with everything.
    """
    tok = sets.select("key", "tokens", F.explode("tokens").alias("token"))
    freq = tok.groupBy("token").agg(F.count("*").alias("f"))
    ranked = tok.join(freq, "token").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("r"))
    n = F.size("r")
    prefix = ranked.select("key", F.transform("r", lambda x: x["token"]).alias("tokens"), F.explode(F.slice("r", F.lit(1), (n - F.ceil(n * min_jaccard - 1e-9) + 1).cast("int"))["token"]).alias("token"))
    a = prefix.select("token", F.col("key").alias("key_a"), F.col("tokens").alias("ta"))
    b = prefix.select("token", F.col("key").alias("key_b"), F.col("tokens").alias("tb"))
    # sizes that differ too much cannot reach the threshold
    near = (F.size("ta") >= F.size("tb") * min_jaccard - 1e-9) & (F.size("tb") >= F.size("ta") * min_jaccard - 1e-9)
    j = a.join(b, "token").where((F.col("key_a") < F.col("key_b")) & near).select("key_a", "key_b", "ta", "tb").distinct()
    j = j.select("key_a", "key_b", F.size(F.array_intersect("ta", "tb")).alias("common"), F.size(F.array_union("ta", "tb")).alias("total"))
    return j.where(F.col("common") / F.col("total") >= min_jaccard)


def scored_sets(facts: DataFrame, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """``key_a, key_b, score``: the better of both channels for each pair of token sets (JOIN-10, SET-1).

    Names of one canonical metric score 1, other pairs their Jaccard.  A pair of
    sets stands for all pairs of their facts; membership is the set's key.
    """
    j = similar_sets(token_sets(facts), min_jaccard).select("key_a", "key_b", (F.col("common") / F.col("total")).alias("score"))
    m = facts.where("metric is not null and metric_id != ''").select("metric", "metric_id").distinct()
    m = m.select("metric_id", F.array_join(F.array_sort(metric_tokens(F.col("metric"))), " ").alias("key")).where("key != ''").distinct()
    same = m.select("metric_id", F.col("key").alias("key_a")).join(m.select("metric_id", F.col("key").alias("key_b")), "metric_id").where("key_a < key_b")
    both = j.unionByName(same.select("key_a", "key_b", F.lit(1.0).alias("score")))
    return both.groupBy("key_a", "key_b").agg(F.round(F.max("score"), 6).alias("score"))


def ranked_in_group(facts: DataFrame, group: list[str], order: str = "id") -> DataFrame:
    """Adds ``rank`` (from 0) within a group in id order, by two levels.

    Counts per id bucket are summed first, so no window ever holds more than
    one bucket of a group, however large the group is.
    """
    f = facts.withColumn("bucket", F.shiftright(order, BUCKET_BITS))
    n = f.groupBy(*group, "bucket").agg(F.count("*").alias("n"))
    before = n.withColumn("before", F.sum("n").over(Window.partitionBy(*group).orderBy("bucket")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy(*group, "bucket").orderBy(order)) - 1
    j = f.withColumn("inside", inside).alias("f").join(before.alias("b"), [F.col(f"f.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "bucket"]])
    return j.select("f.*", (F.col("before") + F.col("inside")).alias("rank")).drop("bucket", "inside")


def capped_uniform(facts: DataFrame, cap: int = MAX_PAIRS) -> DataFrame:
    """``fact_a, fact_b`` chosen where all pairs of a (metric, unit) class are allowed alike (TOPK-2, closed form).

    Greedy choice in id order with at most cap pairs a fact accepts exactly the
    pairs within runs of cap + 1 ranks, so pairs grow with the facts, not with
    their square.
    """
    f = facts.where("metric_id is not null and metric_id != ''").select("id", "metric_id", F.coalesce("canon_unit", F.lit("")).alias("unit"))
    r = ranked_in_group(f, ["metric_id", "unit"]).withColumn("run", F.expr(f"rank div {cap + 1}"))
    g = r.groupBy("metric_id", "unit", "run").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # at most cap + 1 ids
    p = g.select(F.explode(F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, F.lit(cap + 1)), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    return p.select(F.col("p.a").alias("fact_a"), F.col("p.b").alias("fact_b"))


def _known(unit: str | None) -> str | None:
    return None if unit is None or unit in ("", "UNKNOWN") else unit


class CappedFold:
    """Greedy choice of pairs of one group as a fold over its facts in id order.

    Greedy choice in (a, b) order accepts a pair if both facts have room.  What
    decides a pair (a, b) are pairs of a or b with smaller partners, so meeting
    the facts in id order and offering each the earlier ones that still have
    room, smallest first, accepts the same pairs.  Facts that may all pair with
    each other are never open in greater number than the cap, so the fold holds
    at most ``cap`` facts for each kind of fact, however long the group is.
    """

    def __init__(self, cap: int) -> None:
        self.cap = cap
        self.open: list[list] = []  # [id, room, unit, metric_id, tokens, entity] by id

    def add(self, fact: int, unit: str | None, metric: str | None, tokens: str | None, entity: str | None) -> list[int]:
        """Partners of a fact among the earlier ones."""
        room, found = self.cap, []
        for other in self.open:
            if unit is not None and other[2] is not None and unit != other[2]:
                continue
            if not (metric and metric == other[3]):
                if tokens is None or tokens != other[4]:
                    continue
                if entity and other[5] and entity != other[5] and metric != other[3]:
                    continue
            found.append(other[0])
            other[1] -= 1
            room -= 1
            if not room:
                break
        if found:
            self.open = [o for o in self.open if o[1]]
        if room:
            self.open.append([fact, room, unit, metric, tokens, entity])
        return found


_CHOSEN = "fact_a bigint, fact_b bigint, room int"


def _fold(keyed: DataFrame, cap: int) -> DataFrame:
    """``fact_a, fact_b`` of chosen pairs, and ``fact_a, room`` of facts with room left, of facts with a ``grp``.

    Each group streams through one fold in id order: a task holds a batch and
    the open facts, never a group.
    """

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["fact_a", "fact_b", "room"]).astype({"fact_a": "int64", "fact_b": "Int64", "room": "Int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, fold = None, CappedFold(cap)
        rows: list[tuple] = []
        none = lambda c: [None if v is None or v != v else v for v in c.tolist()]
        for b in batches:
            for g, i, u, m, t, e in zip(b["grp"].tolist(), b["id"].tolist(), none(b["unit"]), none(b["metric_id"]), none(b["tokens"]), none(b["entity_id"])):
                if g != group:
                    rows += [(o[0], None, o[1]) for o in fold.open]
                    group, fold = g, CappedFold(cap)
                rows += [(a, i, None) for a in fold.add(i, _known(u), m, t, e)]
            yield frame(rows)
            rows.clear()
        yield frame([(o[0], None, o[1]) for o in fold.open])

    s = keyed.repartition("grp").sortWithinPartitions("grp", "id").select("grp", "id", "unit", "metric_id", "tokens", "entity_id")
    return s.mapInPandas(run, _CHOSEN)


def capped_by_metric(facts: DataFrame, cap: int = MAX_PAIRS) -> DataFrame:
    """``fact_a, fact_b`` of the greedy choice within each metric (TOPK-2 over the metric channel)."""
    f = facts.where("metric_id is not null and metric_id != ''").select(
        F.xxhash64("metric_id").alias("grp"), "id", F.col("canon_unit").alias("unit"), "metric_id", F.lit(None).cast("string").alias("tokens"), F.lit(None).cast("string").alias("entity_id"))
    return _fold(f, cap).where("fact_b is not null").select("fact_a", "fact_b")


#: Links between names up to so many are grouped in one task; more of them by rounds over the cluster.
ONE_TASK_LINKS = 1_000_000


def grouped(links: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """``v, grp``: the smallest vertex of each vertex's component, of links ``a, b``."""
    links = cut(links.where("a != b").distinct())
    if links.count() <= one_task:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [b for b in batches if len(b)]
            if held:
                yield pd.DataFrame(dict(zip(("v", "grp"), components(*(np.concatenate([b[c].to_numpy() for b in held]) for c in "ab")))))

        return links.coalesce(1).mapInPandas(run, "v bigint, grp bigint")
    t = Scratch(links.sparkSession)
    both = t.cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = t.cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("grp")))
    while True:
        # the smallest label among the neighbours, then the label's own label
        near = both.join(label.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("grp").alias("near"))
        step = label.join(near, "v").select("v", "grp", F.least("grp", "near").alias("low"))
        up = label.select(F.col("v").alias("low"), F.col("grp").alias("up"))
        new = t.cut(step.join(up, "low", "left").select("v", F.least("low", F.coalesce("up", "low")).alias("grp"), (F.least("low", F.coalesce("up", "low")) != F.col("grp")).alias("moved")))
        label = new.drop("moved")
        if new.where("moved").isEmpty():
            out = cut(label)
            t.drop()
            return out


def _named(facts: DataFrame) -> DataFrame:
    """Facts with ``words`` of their metric, ``tokens`` (hash of the words, null without any) and ``m`` (hash of the metric id, null without)."""
    f = facts.select("id", F.col("canon_unit").alias("unit"), "metric_id", "entity_id", F.array_sort(metric_tokens(F.coalesce("metric", F.lit("")))).alias("words"))
    f = f.select("*", F.when(F.size("words") > 0, F.xxhash64(F.array_join("words", " "))).alias("tokens"), F.when(F.coalesce("metric_id", F.lit("")) != "", F.xxhash64(F.lit("metric"), "metric_id")).alias("m"))
    return f.where("tokens is not null or m is not null")


def candidate_pairs(facts: DataFrame, cap: int = MAX_PAIRS, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """``fact_a, fact_b, score`` of the facts worth comparing: both channels, the full predicate, one joint cap.

    Facts pair by canonical metric (score 1) or by similar metric words (their
    Jaccard); not if their units are known and differ, nor if both entities are
    known and differ and the metrics differ (JOIN-7 to JOIN-10).  Pairs are
    taken by falling score, then by ids, while both facts have fewer than
    ``cap`` (TOPK-2).

    Pairs of score 1 are chosen first, by a fold over each group of names, so
    they are never listed.  Only facts that still have room can have others,
    and of facts alike in name and unit no more than ``cap`` have; their lower
    pairs are listed and taken in order, streamed by component.
    """
    f = _named(facts)
    # names that score 1 with each other: of one metric, or of the same words
    linked = f.where("tokens is not null and m is not null").select(F.col("tokens").alias("a"), F.col("m").alias("b"))
    group = cut(grouped(linked))
    key = F.coalesce("m", "tokens")
    one = f.withColumn("key", key).join(group.withColumnRenamed("v", "key"), "key", "left").withColumn("grp", F.coalesce("grp", "key")).withColumn("tokens", F.hex("tokens"))
    first = cut(_fold(one, cap))
    chosen = first.where("fact_b is not null").select("fact_a", "fact_b", F.lit(1.0).alias("score"))
    left = cut(f.where("tokens is not null").join(first.where("room is not null").select(F.col("fact_a").alias("id"), "room"), "id").select("id", "unit", "metric_id", "entity_id", "tokens", "words", "room"))
    sets = left.groupBy("words").agg(F.count("*").alias("facts")).select("facts", F.col("words").alias("tokens"), F.array_join("words", " ").alias("key"))
    near = cut(similar_sets(sets, min_jaccard).select(F.xxhash64("key_a").alias("ta"), F.xxhash64("key_b").alias("tb"), (F.col("common") / F.col("total")).alias("score")))
    comp = cut(grouped(near.select(F.col("ta").alias("a"), F.col("tb").alias("b"))))
    side = lambda p: left.select(F.col("tokens").alias(f"t{p}"), F.struct("id", "unit", "metric_id", "entity_id", "room").alias(p))
    e = near.join(side("a"), "ta").join(side("b"), "tb")
    differ = F.coalesce(F.nullif("a.entity_id", F.lit("")) != F.nullif("b.entity_id", F.lit("")), F.lit(False)) & ~F.col("a.metric_id").eqNullSafe(F.col("b.metric_id"))
    # pairs of one metric were offered at score 1
    same = F.coalesce(F.nullif("a.metric_id", F.lit("")) == F.nullif("b.metric_id", F.lit("")), F.lit(False))
    e = e.where(units_compatible(F.col("a.unit"), F.col("b.unit")) & ~differ & ~same)
    e = e.join(comp.select(F.col("v").alias("ta"), "grp"), "ta")
    low_first = F.col("a.id") < F.col("b.id")
    pick = lambda c: (F.when(low_first, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")), F.when(low_first, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")))
    (x, y), (rx, ry) = pick("id"), pick("room")
    e = e.select("grp", "score", x.alias("fact_a"), y.alias("fact_b"), rx.alias("room_a"), ry.alias("room_b"))
    return chosen.unionByName(_taken(e))


def _taken(edges: DataFrame) -> DataFrame:
    """Edges ``grp, score, fact_a, fact_b, room_a, room_b`` taken in order while both facts have room; streamed by component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, room = None, {}
        for b in batches:
            rows = []
            for g, s, x, y, rx, ry in zip(*(b[c].tolist() for c in ("grp", "score", "fact_a", "fact_b", "room_a", "room_b"))):
                if g != group:
                    group, room = g, {}
                if (p := room.get(x, rx)) > 0 and (q := room.get(y, ry)) > 0:
                    room[x], room[y] = p - 1, q - 1
                    rows.append((x, y, s))
            yield pd.DataFrame(rows, columns=["fact_a", "fact_b", "score"]).astype({"fact_a": "int64", "fact_b": "int64", "score": "float64"})

    s = edges.repartition("grp").sortWithinPartitions("grp", F.desc("score"), "fact_a", "fact_b")
    return s.mapInPandas(run, "fact_a bigint, fact_b bigint, score double")


def affected(facts: DataFrame, new_facts: DataFrame, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """Facts whose pairs can change when new ones arrive: those of the names that are linked with names of new facts, over any number of links (STR-3).

    ``facts`` holds the new ones too.  Pairs of all other facts stay as they are.
    """
    f = _named(facts)
    sets = f.where("tokens is not null").groupBy("words").agg(F.count("*").alias("facts")).select("facts", F.col("words").alias("tokens"), F.array_join("words", " ").alias("key"))
    near = similar_sets(sets, min_jaccard).select(F.xxhash64("key_a").alias("a"), F.xxhash64("key_b").alias("b"))
    links = near.unionByName(f.where("tokens is not null and m is not null").select(F.col("tokens").alias("a"), F.col("m").alias("b")))
    comp = grouped(links).withColumnRenamed("v", "key")
    of = f.select("id", F.coalesce("m", "tokens").alias("key")).join(comp, "key", "left").select("id", F.coalesce("grp", "key").alias("grp"))
    touched = of.join(new_facts.select("id").distinct(), "id", "left_semi").select("grp").distinct()
    return facts.join(of.join(touched, "grp", "left_semi").select("id"), "id", "left_semi")
