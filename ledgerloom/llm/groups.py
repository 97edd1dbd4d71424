"""Pairwise matches to groups (problem 5).

Rounds of reduction on the edge table: vertices of degree one are stripped,
chains of degree-two vertices are ranked by pointer doubling and replaced by
one edge.  What is left, the core, is solved in one task once it has at most
CORE_EDGES edges; a larger one that reduces no further is contracted by
hooking every vertex to its smallest neighbour until it has.  Removed vertices
keep a pointer to a vertex that outlived them; labels flow back along the
pointers in reverse.  Lineage is cut after every step; no vertex or edge goes
to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.graphs import components
from ledgerloom.session import Scratch, cut

#: A core of up to so many edges (16 bytes each) is solved in one task.
CORE_EDGES = 1_000_000
#: Groups of more vertices than this get their identifier by a broadcast list instead of a join on one key.
HOT_GROUP = 100_000
#: At most so many groups are on that list: the bound rises with the number of vertices.
MAX_HOT = 10_000


def linked_pairs(relations: DataFrame, verdict: str = "corroborates") -> DataFrame:
    """``a, b`` (a < b) of pairs whose row with the highest id has the verdict.

    Pairs with a null side and pairs of a fact with itself link nothing; a
    null verdict is no link; of rows with equal ids a linking one wins.
    """
    r = relations.where("fact_a is not null and fact_b is not null and fact_a != fact_b").select(
        F.least("fact_a", "fact_b").alias("a"), F.greatest("fact_a", "fact_b").alias("b"),
        (F.shiftleft(F.coalesce("id", F.lit(-1)), 1) + F.coalesce(F.col("final_verdict") == verdict, F.lit(False)).cast("bigint")).alias("last"))
    return r.groupBy("a", "b").agg(F.max("last").alias("last")).where("last & 1 = 1").select("a", "b")


def _cut_moving(df: DataFrame, t: Scratch) -> tuple[DataFrame, bool]:
    """Cut df; tell whether any row of it moved."""
    out = t.cut(df)
    return out.drop("moved"), not out.where("moved").isEmpty()


def _degrees(e: DataFrame) -> DataFrame:
    both = e.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("x"))
    return both.select("x.v", "x.u").groupBy("v").agg(F.count("*").alias("n"), F.min("u").alias("lo"), F.max("u").alias("hi"))


def _strip(e: DataFrame, t: Scratch) -> tuple[DataFrame, DataFrame]:
    """Edges without those to leaves, and (v, p) of the leaves."""
    leaf = _degrees(e).where("n = 1").select("v", F.least("v", "lo").alias("a"), F.greatest("v", "lo").alias("b"))
    # an edge between two leaves is met twice: its larger end goes
    gone = t.cut(leaf.groupBy("a", "b").agg(F.max("v").alias("v")).select("a", "b", "v", F.expr("a + b - v").alias("p")))
    return t.cut(e.join(gone.select("a", "b").hint("merge"), ["a", "b"], "left_anti")), gone.select("v", "p")


def _compress(e: DataFrame, t: Scratch) -> tuple[DataFrame, DataFrame]:
    """Edges with chains replaced by single edges, and (v, p) of their inner vertices.

    A degree-two vertex below both neighbours stays as an end, so every cycle
    has an end and the doubling always stops.
    """
    inner = t.cut(_degrees(e).where("n = 2 and v > lo").select("v", "lo", "hi"))
    if inner.isEmpty():
        return e, inner.select("v", F.col("lo").alias("p"))
    arcs = t.cut(inner.select(F.explode(F.array(
        F.struct(F.col("lo").alias("s"), F.col("v").alias("t"), F.col("v").alias("ns"), F.col("hi").alias("nt")),
        F.struct(F.col("hi").alias("s"), F.col("v").alias("t"), F.col("v").alias("ns"), F.col("lo").alias("nt")))).alias("x")).select("x.*"))
    while True:
        step = arcs.select(F.col("s").alias("ns"), F.col("t").alias("nt"), F.col("ns").alias("js"), F.col("nt").alias("jt"))
        arcs, moved = _cut_moving(arcs.join(step.hint("merge"), ["ns", "nt"], "left").select(
            "s", "t", F.coalesce("js", "ns").alias("ns"), F.coalesce("jt", "nt").alias("nt"), F.col("js").isNotNull().alias("moved")), t)
        if not moved:
            break
    ends = t.cut(arcs.groupBy(F.col("t").alias("v")).agg(F.min("nt").alias("a"), F.max("nt").alias("b")))
    gone = inner.select("v", F.explode(F.array("lo", "hi")).alias("u")).select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b"))
    left = e.join(gone.hint("merge"), ["a", "b"], "left_anti").unionByName(ends.where("a != b").select("a", "b"))
    return t.cut(left.distinct()), ends.select("v", F.col("a").alias("p"))


def _contract(e: DataFrame, t: Scratch) -> tuple[DataFrame, DataFrame]:
    """Hook every vertex to its smallest neighbour, contract; (v, p) of the hooked."""
    hook = t.cut(_degrees(e).where("lo < v").select("v", F.col("lo").alias("p")))
    while True:
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("q"))
        hook, moved = _cut_moving(hook.join(up.hint("merge"), "p", "left").select(
            "v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), t)
        if not moved:
            break
    on_a = hook.select(F.col("v").alias("a"), F.col("p").alias("pa"))
    on_b = hook.select(F.col("v").alias("b"), F.col("p").alias("pb"))
    moved = e.join(on_a.hint("merge"), "a", "left").select(F.coalesce("pa", "a").alias("a"), "b").distinct()
    moved = moved.join(on_b.hint("merge"), "b", "left").select("a", F.coalesce("pb", "b").alias("b")).where("a != b")
    return t.cut(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), hook


def _core(e: DataFrame, t: Scratch) -> DataFrame:
    """(v, p) of a core of at most CORE_EDGES edges, solved in one task; p is the smallest vertex of the component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            v, p = components(*(np.concatenate([b[c].to_numpy() for b in held]) for c in "ab"))
            yield pd.DataFrame({"v": v[v != p], "p": p[v != p]})

    return t.cut(e.coalesce(1).mapInPandas(run, "v bigint, p bigint"))


def _with_group(labels: DataFrame, t: Scratch) -> DataFrame:
    """``fact_id, group_id`` from (v, root): the smallest vertex of each root's group, for the root too."""
    roots = t.cut(labels.groupBy("root").agg(F.min("v").alias("low"), F.count("*").alias("n")).select("root", F.least("low", "root").alias("group_id"), "n"))
    most = max(HOT_GROUP, (roots.agg(F.sum("n")).first()[0] or 0) // MAX_HOT)
    hot = roots.where(F.col("n") > most).select("root", F.col("group_id").alias("hot_id"))
    own = roots.select(F.col("root").alias("fact_id"), "group_id")
    rest = roots.where(F.col("n") <= most).select("root", "group_id")
    if hot.isEmpty():
        return labels.join(rest.hint("merge"), "root").select(F.col("v").alias("fact_id"), "group_id").unionByName(own)
    m = labels.join(F.broadcast(hot), "root", "left")
    cold = m.where("hot_id is null").join(rest.hint("merge"), "root").select(F.col("v").alias("fact_id"), "group_id")
    return m.where("hot_id is not null").select(F.col("v").alias("fact_id"), F.col("hot_id").alias("group_id")).unionByName(cold).unionByName(own)


def groups(edges: DataFrame, core_edges: int = CORE_EDGES, unique: bool = False) -> DataFrame:
    """``fact_id, group_id`` of every vertex; group_id is the smallest vertex of its component.

    No edges: no rows.  Repeated edges and either direction of an edge count
    once; ``unique`` says that every edge stands once with a < b.
    """
    t = Scratch(edges.sparkSession)
    once = edges if unique else edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    e = t.cut(once.select("a", "b"))
    log: list[DataFrame] = []
    n, first, reduces = e.count(), True, True
    while n:
        if n <= core_edges and not first:
            log.append(_core(e, t))
            break
        if reduces:
            e, gone = _strip(e, t)
            log.append(gone)
            if not e.isEmpty():
                e, gone = _compress(e, t)
                log.append(gone)
        else:
            e, gone = _contract(e, t)
            log.append(gone)
        before, n = n, e.count()
        # contraction makes new leaves and chains, so reduction is tried again after it
        first, reduces = False, n < before or not reduces
    if not log:
        out = cut(e.select(F.col("a").alias("fact_id"), F.col("b").alias("group_id")))
        t.drop()
        return out
    labels = None
    for gone in reversed(log):
        if labels is None:
            labels = gone.select("v", F.col("p").alias("root"))
        else:
            known = labels.select(F.col("v").alias("p"), F.col("root").alias("r"))
            labels = t.cut(labels.unionByName(gone.join(known.hint("merge"), "p", "left").select("v", F.coalesce("r", "p").alias("root"))))
    out = cut(_with_group(labels, t))
    t.drop()
    return out
