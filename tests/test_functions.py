"""Column functions against the written vectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text, values
from ledgerloom.functions.periods import with_printed_period


def _one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in cols.items()))
    return df.select(expr).first()[0]


@pytest.mark.parametrize("raw, want", [("(452)", -452.0), ("-1,008", -1008.0), ("-(5)", None), ("( -5 )", 5.0), ("- 5", None), ("--5", None), ("10-12", 10.0),
                                       ("1.2.3", 1.2), ("1e5", 1.0), ("FY24 12", 24.0), ("२", 2.0), ("n/a", None), ("", None), (None, None)])
def test_parse_number(spark, raw, want):
    assert _one(spark, values.parse_number(F.col("a")), a=raw) == want


@pytest.mark.parametrize("value, unit, ctx, want", [
    ("81,415.38", "₹ in Million", None, (8.141538e10, "INR")), ("8,142", "₹ Cr", None, (8.142e10, "INR")), ("74,540.82", "Rs. million", None, (7.454082e10, "INR")),
    ("6.5", "per cent", None, (6.5, "PERCENT")), ("1.4", "Mn Tons", None, (1.4e6, "TONNE")), ("740", "Mn", None, (7.4e8, "UNKNOWN")), ("31", "days", None, (31.0, "DAYS")),
    ("(452)", "₹ Cr", None, (-4.52e9, "INR")), ("-1,008", "Cr", None, (-1.008e10, "UNKNOWN")), ("substantially higher", None, None, (None, None)),
    ("42", "I", None, (42.0, "COUNT")), ("81,415.38", "I in Million", None, (8.141538e10, "INR")), ("81,415.38", None, "stood at ₹ 81,415.38 million", (81415.38, "INR")),
    ("6.5", "per cent", "₹ 5", (6.5, "PERCENT")), ("740", "Mn shipments", None, (7.4e8, "COUNT")), ("5", "customers", None, (5.0, "INR")), ("1", "lakh crore", None, (1e7, "UNKNOWN"))])
def test_canonical_pair(spark, value, unit, ctx, want):
    r = values.with_canonical_pair(spark.createDataFrame([(value, unit, ctx)], "v string, u string, c string"), "v", "u", "c").first()
    assert r.canon_unit == want[1] and r.canon_value == (want[0] if want[0] is None else pytest.approx(want[0], rel=1e-12))


@pytest.mark.parametrize("raw, want", [("1.4", 2), ("1,429", 4), ("76", 2), ("758", 3), ("0.9", 1), (None, None), ("n/a", None), ("8,142", 4), ("100", 1)])
def test_significant_figures(spark, raw, want):
    assert _one(spark, values.significant_figures(F.col("a")), a=raw) == want


@pytest.mark.parametrize("a, b, ra, rb, want", [
    (8.142e10, 8.141538e10, None, None, True), (7.454082e10, 8.141538e10, None, None, False), (1.4e6, 1.429e6, None, None, False), (1.4e6, 1.429e6, "1.4", "1,429", True),
    (2.675, 2.67, "2.675", "2.67", True), (2.675, 2.68, "2.675", "2.68", False), (-2.5, -2.0, "-2.5", "-2", True), (3.5, 4.0, "3.5", "4", True), (0.0, 1.0, "0", "1", False),
    (7.6e8, 7.58e8, "76", "758", True), (0.9, 1.6, "0.9", "1.6", False), (6.5, 6.6, "6.5", "6.6", False)])
def test_values_agree(spark, a, b, ra, rb, want):
    df = spark.createDataFrame([(a, b, ra, rb)], "a double, b double, ra string, rb string")
    assert values.with_agreement(df, F.col("a"), F.col("b"), F.col("ra"), F.col("rb")).first().agree is want


def test_rounding_is_exact(spark):
    """Against Python's rounding, which is exact on the binary value: random values, printed ties and their neighbours."""
    r = random.Random(12)
    rows = [(r.uniform(-1, 1) * 10 ** r.randrange(-6, 14), r.randrange(1, 9)) for _ in range(1500)]
    for _ in range(1500):  # a decimal tie at the last figure
        n, e = r.randrange(1, 8), r.randrange(-5, 9)
        v = float(f"{r.choice('+-')}{r.randrange(10 ** (n - 1), 10 ** n)}5e{e}")
        rows += [(v, n), (math.nextafter(v, 0), n), (math.nextafter(v, math.inf), n)]
    df = values.with_rounded(spark.createDataFrame([*rows, (0.0, 3), (None, 2), (1.5, None)], "v double, n int"), F.col("v"), F.col("n"), "r")
    for x in df.collect():
        want = None if x.v is None or x.n is None else 0.0 if x.v == 0 else round(x.v, -(math.floor(math.log10(abs(x.v))) - x.n + 1))
        assert x.r == want or abs(x.r - want) <= 1e-15 * abs(want), (x, want)


@pytest.mark.parametrize("raw, want", [
    ("FY24", ("2023-04-01", "2024-03-31", "fiscal_year")), ("year ended March 31, 2024", ("2023-04-01", "2024-03-31", "fiscal_year")), ("2024-25", ("2024-04-01", "2025-03-31", "fiscal_year")),
    ("FY2025/26", ("2025-04-01", "2026-03-31", "fiscal_year")), ("Q4 FY24", ("2024-01-01", "2024-03-31", "quarter")), ("Q1 FY25", ("2024-04-01", "2024-06-30", "quarter")),
    ("as on March 31, 2024", ("2024-03-31", "2024-03-31", "instant")), ("CY2025", ("2025-01-01", "2025-12-31", "calendar_year")), ("recently", (None,) * 3),
    ("year ended December 31, 2023", ("2022-12-01", "2023-12-31", "part_year")), ("nine months ended December 31, 2023", (None,) * 3), ("2024-03-31", ("2002-04-01", "2003-03-31", "fiscal_year")),
    ("as on February 30, 2024", (None,) * 3), (None, (None,) * 3)])
def test_printed_period(spark, raw, want):
    r = with_printed_period(spark.createDataFrame([(raw,)], "a string"), "a").first()
    assert (r.period_start, r.period_end, r.period_kind) == want


def test_locate(spark):
    t = "Revenue  rose\nto 5. (net) of \\E it."
    for q, want in (("rose\nto", "rose\nto"), ("Revenue rose to", "Revenue  rose\nto"), ("5. (net)", "5. (net)"), ("of  \\E it", "of \\E it"), ("absent", None), ("", None), ("   ", None), (None, None)):
        r = spark.createDataFrame([(t, q)], "t string, q string").select(text.locate(F.col("t"), F.col("q")).alias("x")).first().x
        assert (None if r is None else t[r.start:r.end]) == want


def test_slug_and_tokens(spark):
    assert [_one(spark, text.slug(F.col("a")), a=x) for x in ("Net  Profit (PAT)", "₹₹", "")] == ["net_profit_pat", "unnamed", "unnamed"]
    assert _one(spark, text.metric_tokens(F.col("a")), a="Change in the GDP of a GDP at 2024") == ["change", "gdp", "2024"]
