"""Printed periods by a list of search patterns, first hit wins (SCL-20 to SCL-28).

Unlike :mod:`ledgerloom.functions.timeparse`, which reads a whole text, these
patterns are searched for anywhere in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import collapse

# Month names in order.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# The patterns.
QUARTER = r"q([1-4]) ?(?:of ?)?fy ?'?([0-9]{2,4})"
FY_PAIR = r"fy ?'?([0-9]{4}) ?[/-] ?([0-9]{2,4})"
FY = r"fy ?'?([0-9]{2,4})($|[^0-9a-z_])"
PAIR = r"(^|[^0-9a-z_])(20[0-9]{2}) ?[-/] ?([0-9]{2})($|[^0-9a-z_])"
AS_ON = r"as (?:on|at|of) ([a-z]+) ([0-9]{1,2}),? ?([0-9]{4})"
ENDED = r"year ended ([a-z]+) ([0-9]{1,2}),? ?([0-9]{4})"
CALENDAR = r"(^|[^0-9a-z_])cy ?(20[0-9]{2})($|[^0-9a-z_])"


def _expand(y: Column) -> Column:
    return F.when(y > 100, y).otherwise(2000 + y)


def with_printed_period(df: DataFrame, raw: str) -> DataFrame:
    """df with ``period_start, period_end, period_kind``: ISO strings; three nulls where nothing is found or a date does not exist.

    Each rule is one struct of a chain that is worked out once.
    """
    t = F.col("_t")
    g = lambda p, i: F.regexp_extract(t, p, i)
    n = lambda p, i: g(p, i).try_cast("int")
    mon = lambda c: F.array_position(F.array(*[F.lit(m) for m in MONTHS]), c).cast("int")
    day = lambda y, m, d: F.date_format(F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date"), "yyyy-MM-dd")
    last = lambda y, m: F.date_format(F.last_day(F.format_string("%04d-%02d-01", y, m).try_cast("date")), "yyyy-MM-dd")
    out = lambda start, end, kind: F.struct(start.alias("start"), end.alias("end"), kind.alias("kind"))
    fy = lambda y: out(day(y - 1, F.lit(4), F.lit(1)), day(y, F.lit(3), F.lit(31)), F.lit("fiscal_year"))
    q, qy = n(QUARTER, 1), _expand(n(QUARTER, 2))
    q_year, q_month = F.when(q == 4, qy).otherwise(qy - 1), F.when(q == 4, 1).otherwise(3 * q + 1)
    tail = n(FY_PAIR, 2)
    am, em, ey = mon(g(AS_ON, 1)), mon(g(ENDED, 1)), n(ENDED, 3)
    on = day(n(AS_ON, 3), am, n(AS_ON, 2))
    cy = F.coalesce(n(CALENDAR, 2), F.when(t.rlike("^20[0-9]{2}$"), t.try_cast("int")))
    rules = [
        (t.rlike(QUARTER), out(day(q_year, q_month, F.lit(1)), last(q_year, q_month + 2), F.lit("quarter"))),
        (t.rlike(FY_PAIR), fy(F.when(tail < 100, _expand(tail)).otherwise(tail))),
        (t.rlike(FY), fy(_expand(n(FY, 1)))),
        (t.rlike(PAIR), fy(_expand(n(PAIR, 3)))),
        (t.rlike(AS_ON) & am.between(1, 12), out(on, on, F.when(on.isNotNull(), "instant"))),
        (t.rlike(ENDED) & (em == 3), fy(ey)),
        (t.rlike(ENDED) & em.between(1, 12), out(day(ey - 1, em, F.lit(1)), last(ey, em), F.lit("part_year"))),
        (cy.isNotNull(), out(day(cy, F.lit(1), F.lit(1)), day(cy, F.lit(12), F.lit(31)), F.lit("calendar_year"))),
    ]
    c = F.lit(None)
    for cond, res in reversed(rules):
        c = F.when(cond, res).otherwise(c)
    df = df.withColumn("_t", F.lower(collapse(F.col(raw)))).withColumn("_p", c)
    return df.withColumns({f"period_{k}": F.col(f"_p.{k}") for k in ("start", "end", "kind")}).drop("_t", "_p")
