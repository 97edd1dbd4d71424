"""Printed numbers, units and their agreement (SCL-13 to SCL-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import SPACE

# Scale words in the order in which they are looked for.
SCALE_ORDER = (("thousand", 1e3), ("trillion", 1e12), ("million", 1e6), ("billion", 1e9), ("crore", 1e7), ("lakh", 1e5),
               ("lac", 1e5), ("mio", 1e6), ("mn", 1e6), ("cr", 1e7), ("bn", 1e9), ("tn", 1e12), ("k", 1e3))
# Patterns of the unit families.
PERCENT = r"per cent|percent|%|percentage point|bps"
INR = r"₹|rs\.?|inr|rupee"
USD = r"\$|usd|us ?dollar"
MANGLED = r"(^|[\s(])[i`¹¦]\s*(in\s+)?(million|mn|crore|cr|lakh|billion|bn|thousand)($|[^a-z0-9_])"
DIGITS = ("०१२३४५६७८९", "0123456789")
NUMBER = rf"-?\(?{SPACE}*-?[0-9,]*\.?[0-9]+{SPACE}*\)?"


def whole(words: str) -> str:
    """Pattern of whole words, the boundaries written out."""
    return rf"(^|[^a-z0-9_])({words})s?($|[^a-z0-9_])"


def parse_number(raw: Column) -> Column:
    """First printed number; in brackets negative; null if its text is no number."""
    tok = F.trim(F.regexp_replace(F.regexp_substr(F.translate(raw, *DIGITS), F.lit(NUMBER)), SPACE + "+", " "))
    negative = tok.startswith("(") & tok.endswith(")")
    bare = F.trim(F.replace(F.btrim(tok, F.lit("()")), F.lit(","), F.lit("")))
    value = F.when(bare.rlike(r"^-?[0-9]*\.?[0-9]+$"), bare.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def _blob(value_raw: Column, unit_raw: Column) -> Column:
    return F.lower(F.concat(F.coalesce(value_raw, F.lit("")), F.lit(" "), F.coalesce(unit_raw, F.lit(""))))


def scale_of(blob: Column) -> Column:
    """The factor of the first scale word, in the order of the list; most texts have none and are done after one search."""
    out = F.lit(1.0)
    for word, factor in reversed(SCALE_ORDER):
        out = F.when(blob.rlike(whole(word)), F.lit(factor)).otherwise(out)
    return F.when(~blob.rlike(whole("|".join(w for w, _ in SCALE_ORDER))), F.lit(1.0)).otherwise(out)


def with_canonical_pair(df: DataFrame, value_raw: str, unit_raw: str, context: str) -> DataFrame:
    """df with ``canon_value`` and ``canon_unit`` by the decision list (SCL-15); both null without a number.

    Number, texts and unit are columns one after the other, so each is worked
    out once.
    """
    words = "|".join(w for w, _ in SCALE_ORDER)
    low = F.lower(F.coalesce(unit_raw, F.lit("")))
    # neighbours share a boundary, so the words are taken out twice
    drop = rf"(^|[^a-z0-9_])(?:(?:{words})s?|in)($|[^a-z0-9_])"
    residue = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), F.col("_low"), F.lit(" ")), drop, "$1 $2"), drop, "$1 $2"), "[^a-z]+", "")
    n, blob, ctx = F.col("_n"), F.col("_blob"), F.lower(F.coalesce(context, F.lit("")))
    unit = (F.when(n.isNull(), F.lit(None).cast("string"))
            .when(blob.rlike(PERCENT), "PERCENT").when(blob.rlike(whole("ton|tonne|mt")), "TONNE").when(blob.rlike(whole("day")), "DAYS")
            .when(blob.rlike(INR), "INR").when(blob.rlike(USD), "USD").when(F.col("_low").rlike(MANGLED), "INR")
            .when(ctx.rlike(INR), "INR").when(ctx.rlike(USD), "USD")
            .when(residue == "", "UNKNOWN").otherwise("COUNT"))
    df = df.withColumns({"_n": parse_number(F.col(value_raw)), "_blob": _blob(F.col(value_raw), F.col(unit_raw)), "_low": low}).withColumn("canon_unit", unit)
    return df.withColumn("canon_value", F.when(F.col("canon_unit") == "PERCENT", n).otherwise(n * scale_of(blob))).drop("_n", "_blob", "_low")


def units_compatible(a: Column, b: Column) -> Column:
    """False only where both units are known and differ."""
    known = lambda c: F.nullif(F.nullif(c, F.lit("")), F.lit("UNKNOWN"))
    return F.coalesce(known(a) == known(b), F.lit(True))


def _figures(digits: Column) -> Column:
    frac = F.nullif(F.length(F.ltrim(F.replace(digits, F.lit("."), F.lit("")), F.lit("0"))), F.lit(0))
    whole_ = F.greatest(F.length(F.btrim(digits, F.lit("0"))), F.lit(1))
    return F.when(digits.rlike("[0-9]"), F.when(digits.contains("."), frac).otherwise(whole_)).cast("int")


def _digits(raw: Column) -> Column:
    return F.regexp_replace(F.translate(raw, *DIGITS), "[^0-9.]", "")


def significant_figures(raw: Column) -> Column:
    return _figures(_digits(raw))


def _product_error(a: Column, b: Column) -> Column:
    """What ``a * b`` loses by rounding, exactly: both factors are split in halves whose products are exact."""
    split = lambda x: (x * 134217729.0 - (x * 134217729.0 - x))
    ah, bh = split(a), split(b)
    al, bl = a - ah, b - bh
    return ((ah * bh - a * b) + ah * bl + al * bh) + al * bl


def with_rounded(df: DataFrame, value: Column, figures: Column, name: str) -> DataFrame:
    """df with ``name``: value to significant figures, half to even on the exact binary value (SCL-18); null without figures.

    The mantissa is rounded in generated code.  Its product can hide the exact
    value only where it is a tie; there the lost part of the product decides.
    """
    w, c, p = (F.col(f"_{x}_{name}") for x in "wcp")
    power = (figures - 1 - F.floor(F.log10(F.abs(F.nullif(value, F.lit(0.0)))))).cast("int")
    df = df.withColumn(f"_w_{name}", power).withColumn(f"_c_{name}", F.pow(F.lit(10.0), F.abs(w))).withColumn(f"_p_{name}", F.when(w >= 0, value * c).otherwise(value / c))
    lost = F.when(w >= 0, _product_error(value, c)).otherwise((value - p * c) - _product_error(p, c))
    mantissa = F.when(p - F.floor(p) != 0.5, F.bround(p, 0)).when(lost > 0, F.floor(p) + 1.0).when(lost < 0, F.floor(p).cast("double")).otherwise(F.bround(p, 0))
    out = F.when(figures.isNull() | value.isNull(), F.lit(None)).when((value == 0) | (figures <= 0), F.lit(0.0)).when(w >= 0, mantissa / c).otherwise(mantissa * c)
    return df.withColumn(name, out).drop(f"_w_{name}", f"_c_{name}", f"_p_{name}")


def with_agreement(df: DataFrame, a: Column, b: Column, a_raw: Column, b_raw: Column, tol: float = 1e-3) -> DataFrame:
    """df with ``agree``: equal, within the tolerance, or equal at the coarser printed precision; null values never agree (SCL-19).

    The printed texts are read only where the values are not close.
    """
    close = F.coalesce((a == b) | (F.abs(a - b) <= F.lit(tol) * F.greatest(F.abs(a), F.abs(b))), F.lit(False))
    apart = ~F.col("_close") & a.isNotNull() & b.isNotNull()
    fa, fb = F.col("_fa"), F.col("_fb")
    df = df.withColumn("_close", close).withColumns({"_da": F.when(apart, _digits(a_raw)), "_db": F.when(apart, _digits(b_raw))})
    df = df.withColumns({"_fa": _figures(F.col("_da")), "_fb": _figures(F.col("_db"))}).withColumn("_n", F.when(fa.isNotNull() & fb.isNotNull(), F.least(fa, fb)))
    df = with_rounded(with_rounded(df, a, F.col("_n"), "_ra"), b, F.col("_n"), "_rb")
    same = F.coalesce(F.abs(F.col("_ra") - F.col("_rb")) <= F.abs("_ra") * 1e-12, F.lit(False))
    return df.withColumn("agree", F.col("_close") | same).drop("_close", "_da", "_db", "_fa", "_fb", "_n", "_ra", "_rb")
