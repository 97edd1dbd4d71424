"""Quantities in different units to common units (problem 3).

The number printed in each fact and the unit words beside it are read from the
text.  The stored values then form histories: the facts of one source that use
one notation (unit and scale), in order of arrival, each with ``ln(stored /
printed)``, the logarithm of the conversion the earlier run applied.  An exact
penalised changepoint search (optimal partitioning with pruning) cuts every
history into levels.  The level of the notation's own factor is right; any
other level is a change of unit or scale of the earlier run, and where the
shift is a known factor, dividing by it reverses the change.

The penalty makes the search decide facts one by one where it must: with
penalty ``tol**2 / 8`` an optimal segment holds no value farther than
``tol / 2`` from its mean, for taking such a value out saves more than the two
changepoints cost.  So a value that is off by more than ``tol`` never lies in a
segment within ``tol / 4`` of its factor, whatever stands around it and
wherever a long history is divided between tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerloom.functions.quantities import read_quantity, states_unit
from ledgerloom.session import cut

#: Relative tolerance of a stored value.
TOLERANCE = 1e-3
# Factors between units and scales that sources mix up.
FACTORS = (7.0, 10.0, 12.0, 14.0, 24.0, 60.0, 100.0, 1440.0, 1e3, 1e4, 1e5, 1e6, 1e7, 1e9, 1e12)
# Second coordinate of a history: how the stored pair compares with the text.
SAME, OTHER_UNIT, OTHER_SIGN, NO_NUMBER = 0, 1, 2, 3

_READ = pa.struct([("number", pa.float64()), ("value", pa.float64()), ("unit", pa.string())])


@F.arrow_udf(T.StructType([T.StructField("number", T.DoubleType()), T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType())]))
def _quantity(value_raw: pa.Array, unit_raw: pa.Array, quote: pa.Array) -> pa.Array:
    read = [read_quantity(*x) for x in zip(value_raw.to_pylist(), unit_raw.to_pylist(), quote.to_pylist())]
    n, v, u = zip(*read) if read else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(n, pa.float64()), pa.array(v, pa.float64()), pa.array(u, pa.string())], fields=list(_READ))


@F.arrow_udf(T.BooleanType())
def _states_unit(value_raw: pa.Array, unit_raw: pa.Array) -> pa.Array:
    return pa.array([states_unit(v, u) for v, u in zip(value_raw.to_pylist(), unit_raw.to_pylist())], pa.bool_())


def normalise_quantities(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """``id, doc_id``, stored pair (``was_*``), printed number and stated pair of every fact.

    A null, empty or wordy ``value_raw`` states no number: both results null.
    A fact that names no unit and has no evidence is UNKNOWN.  Repeated
    evidence rows count once (the smallest quote that names a unit wins).  Only
    facts that name no unit are joined with their quotes.
    """
    f = facts.select("id", "doc_id", "value_raw", "unit_raw", F.col("canon_value").alias("was_value"), F.col("canon_unit").alias("was_unit"))
    f = f.withColumn("named", _states_unit("value_raw", "unit_raw") | ~F.coalesce(F.col("value_raw").rlike(r"(?U)\d"), F.lit(False)))
    out = ("id", "doc_id", "was_value", "was_unit", "q.number", "q.value", "q.unit")
    plain = f.where("named").withColumn("q", _quantity("value_raw", "unit_raw", F.lit(None).cast("string"))).select(*out)
    e = evidence.where("fact_id is not null and quote is not null").select("fact_id", "quote").alias("e")
    asked = f.where("not named").withColumn("row", F.struct("doc_id", "value_raw", "unit_raw", "was_value", "was_unit"))
    # one row of the fact per quote, folded again by the fact's whole row
    joined = asked.alias("f").join(e, F.expr("f.id = e.fact_id"), "left").select("id", "row", "quote").distinct()
    read = joined.withColumn("q", _quantity("row.value_raw", "row.unit_raw", "quote"))
    best = read.groupBy("id", "row").agg(F.min(F.struct(F.col("q.unit") == "UNKNOWN", "q")).alias("b"))
    return plain.unionByName(best.select("id", "row.doc_id", "row.was_value", "row.was_unit", "b.q.number", "b.q.value", "b.q.unit"))


def changepoints(values: np.ndarray, penalty: float, kinds: np.ndarray | None = None) -> np.ndarray:
    """Starts of the segments of the exact penalised least-squares partition.

    The sum over segments of squared distance from the segment mean plus
    penalty is minimal; ``kinds`` is a second coordinate of the same signal.  A
    run of equal values is never cut inside: moving a boundary through a run
    changes the cost as a sum of concave functions, so an end of the run is at
    least as good; the search therefore runs over runs.  Candidates that can no
    longer win are pruned (PELT).
    """
    n = len(values)
    if n == 0:
        return np.zeros(0, int)
    kinds = np.zeros(n) if kinds is None else kinds.astype(float)
    starts = np.flatnonzero(np.r_[True, (np.diff(values) != 0) | (np.diff(kinds) != 0)])
    weight = np.diff(np.r_[starts, n]).astype(float)
    level, kind = values[starts], kinds[starts]
    sums = (weight, weight * level, weight * kind, weight * (level * level + kind * kind))
    # plain floats: the candidate sets are small
    cw, cx, ck, cq = (np.r_[0.0, np.cumsum(x)].tolist() for x in sums)
    best, back, live = [-penalty], [0], [0]
    for j in range(1, len(starts) + 1):
        low, at, costs = math.inf, 0, []
        for i in live:
            if i == j - 1:
                c = 0.0  # one run: no cost, whatever cancellation says
            else:
                w = cw[j] - cw[i]
                c = max(cq[j] - cq[i] - ((cx[j] - cx[i]) ** 2 + (ck[j] - ck[i]) ** 2) / w, 0.0)
            costs.append(best[i] + c)
            if costs[-1] < low:
                low, at = costs[-1], i
        best.append(low + penalty)
        back.append(at)
        live = [i for i, c in zip(live, costs) if c <= low + penalty] + [j]
    cuts, j = [], len(starts)
    while j > 0:
        j = back[j]
        cuts.append(starts[j])
    return np.array(cuts[::-1])


_SERIES = ["source", "unit", "factor"]
_ORDER = ["created_at", "doc_id", "id"]
_SEGMENTS = "source string, unit string, factor double, part int, segment int, fact_id bigint, level double, kind int, off boolean, wrong boolean"


def stored_history(quantities: DataFrame, documents: DataFrame) -> DataFrame:
    """``source, unit, factor, created_at, doc_id, id, x, kind, wrong`` of all stored pairs.

    ``factor`` is the logarithm of the notation's own conversion and ``x`` that
    of the one the earlier run applied; ``wrong`` is the exact comparison with
    the text that confirms what the levels say.  Facts of unknown documents
    belong to the null source.  Facts without a stored pair have no place in a
    history.
    """
    s, v, n = F.col("was_value"), F.col("value"), F.col("number")
    kind = (F.when(v.isNull() | F.isnan(s) | ((s == 0) != (v == 0)), NO_NUMBER).when(F.col("was_unit") != F.col("unit"), OTHER_UNIT)
            .when(F.signum(s) != F.signum(v), OTHER_SIGN).otherwise(SAME))
    plain = (n != 0) & (s != 0) & ~F.isnan(s)
    log = lambda c: F.round(F.coalesce(F.when(plain, F.ln(F.abs(c / n))), F.lit(0.0)), 9)
    wrong = v.isNull() | (F.col("was_unit") != F.col("unit")) | ~F.coalesce((s == v) | (F.abs(s / F.nullif(v, F.lit(0.0)) - 1) <= TOLERANCE), F.lit(False))
    q = quantities.where("was_value is not null and was_unit is not null").select(
        "id", "doc_id", "unit", log(v).alias("factor"), log(s).alias("x"), kind.alias("kind"), wrong.alias("wrong"))
    d = documents.where("doc_id is not null").groupBy("doc_id").agg(F.min("source").alias("source"), F.min("created_at").alias("created_at"))
    return q.join(d, "doc_id", "left").select(*_SERIES, *_ORDER, "x", "kind", "wrong")


def _segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of the histories of one partition, which come sorted; rows of those off their factor, and one of each segment at an end."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: list[pd.DataFrame] = []
    tol = math.log1p(TOLERANCE)

    def cut_one(h: pd.DataFrame) -> pd.DataFrame | None:
        x, kind = h["x"].to_numpy(float), h["kind"].to_numpy()
        starts = changepoints(x, tol * tol / 8, kind)
        size = np.diff(np.r_[starts, len(x)])
        seg = np.repeat(np.arange(len(starts)), size)
        level, kinds = np.add.reduceat(x, starts) / size, np.add.reduceat(kind.astype(float), starts) / size
        own = float(h["factor"].iloc[0])
        off = (np.abs(level - own) > tol / 4) | (kinds > 0.25)
        show = off[seg]
        show[starts[0]] = show[starts[-1]] = True
        if not show.any():
            return None
        out = h.loc[show, _SERIES].copy()
        g = seg[show]
        out["part"], out["segment"], out["fact_id"] = part, g, h["id"].to_numpy()[show]
        out["level"], out["kind"], out["off"], out["wrong"] = level[g], np.rint(kinds[g]).astype(int), off[g], h["wrong"].to_numpy()[show]
        return out

    def flush() -> Iterator[pd.DataFrame]:
        if held:
            whole = pd.concat(held, ignore_index=True)
            held.clear()
            name = (whole["source"].fillna("\x00") + "\x00" + whole["unit"].fillna("\x00")).to_numpy()
            own = whole["factor"].to_numpy()
            edge = np.r_[True, (name[1:] != name[:-1]) | (own[1:] != own[:-1])]
            at = np.r_[np.flatnonzero(edge), len(whole)]
            got = [o for a, b in zip(at[:-1], at[1:]) if (o := cut_one(whole.iloc[a:b])) is not None]
            if got:
                yield pd.concat(got, ignore_index=True)

    for b in batches:
        held.append(b)
    yield from flush()


def unit_history(quantities: DataFrame, documents: DataFrame) -> DataFrame:
    """Segments off their notation's factor, one row a fact, and one row of every segment at the end of a task's share.

    Columns ``source, unit, factor, part, segment, fact_id, level, kind, off,
    wrong``.  The histories are sorted by ranges, so one source with a third of
    all rows spreads over many tasks, each of which holds its own range only.
    """
    h = cut(stored_history(quantities, documents))  # the range sort samples it first
    key = [*_SERIES, *_ORDER]
    return h.repartitionByRange(*key).sortWithinPartitions(*key).select(*_SERIES, "id", "x", "kind", "wrong").mapInPandas(_segment, _SEGMENTS)


def wrong_pairs(history: DataFrame) -> DataFrame:
    """``fact_id`` of the facts in segments off their factor, each confirmed by its own text."""
    return history.where("off and wrong").select("fact_id")


def unit_changes(history: DataFrame) -> DataFrame:
    """``source, unit, factor, first_fact, n_facts, level, kind, reverse_factor`` of every segment off its factor with wrong facts.

    ``factor`` and ``level`` are logarithms.  ``kind`` says what changed: scale
    (by a known factor, which ``reverse_factor`` undoes), value (by another),
    unit, sign, or none (no number is printed).  A segment that goes on in the
    next task's range is one segment.
    """
    hit = F.col("off") & F.col("wrong")
    ends = [F.min(F.when(hit, F.col("fact_id"))).alias("first_fact"), F.count_if(hit).alias("n_facts"), F.min("level").alias("level"), F.min("kind").alias("k")]
    seg = history.groupBy(*_SERIES, "part", "segment").agg(*ends)
    # only the last segment of one range and the first of the next can be one
    last = history.groupBy(*_SERIES, "part").agg(F.max("segment").alias("last"))
    s = seg.alias("s").join(last.alias("l"), F.expr("s.source <=> l.source and s.unit <=> l.unit and s.factor = l.factor and s.part = l.part")).select("s.*", "last")
    edge = s.where("segment = 0 or segment = last")
    w = Window.partitionBy(*_SERIES).orderBy("part", "segment")  # at most two rows a task and history
    same = (F.col("segment") == 0) & (F.lag("part").over(w) != F.col("part")) & (F.lag("k").over(w) == F.col("k")) & (F.abs(F.lag("level").over(w) - F.col("level")) <= math.log1p(TOLERANCE) / 2)
    edge = edge.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    joined = edge.groupBy(*_SERIES, "run").agg(F.min("first_fact").alias("first_fact"), F.sum("n_facts").alias("n_facts"), F.min("level").alias("level"), F.min("k").alias("k"))
    cols = [*_SERIES, "first_fact", "n_facts", "level", "k"]
    out = joined.select(*cols).unionByName(s.where("segment != 0 and segment != last").select(*cols)).where("n_facts > 0")
    known = F.lit(None).cast("double")
    for f in FACTORS:
        for g in (f, 1 / f):
            known = F.when(F.abs(F.col("level") - F.col("factor") - math.log(g)) < 1e-6, F.lit(1 / g)).otherwise(known)
    out = out.withColumn("reverse_factor", F.when(F.col("k") == SAME, known))
    kind = (F.when(F.col("k") == OTHER_UNIT, "unit").when(F.col("k") == OTHER_SIGN, "sign").when(F.col("k") == NO_NUMBER, "none")
            .when(F.col("reverse_factor").isNotNull(), "scale").otherwise("value"))
    return out.select(*_SERIES, "first_fact", "n_facts", "level", kind.alias("kind"), "reverse_factor")
