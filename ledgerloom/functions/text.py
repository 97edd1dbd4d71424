"""Text functions: Column -> Column.

White space and digits are Unicode classes written out, so that every engine
reads the patterns alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}]"

# Words left out of a metric's tokens.
STOP_WORDS = ("of", "from", "the", "in", "for", "and", "a", "on", "to")
# Patterns that make a text dense in figures.
DENSE_NUMBER = r"[0-9][0-9,]*\.?[0-9]*"
DENSE_UNIT = r"per cent|percent|%|million|billion|crore|cr(?:$|[^a-z0-9_])|lakh|mn(?:$|[^a-z0-9_])|bn(?:$|[^a-z0-9_])|₹|rs\.?|usd|\$"
DENSE_PERIOD = r"fy[\t\n\f\r ]?[0-9]{2,4}|q[1-4]|20[0-9]{2}|march 31|year ended"


def collapse(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def furniture_key(c: Column) -> Column:
    """Key of page furniture: digit runs to #, white space collapsed, lower case (SCL-1)."""
    return F.lower(collapse(F.regexp_replace(c, r"\p{Nd}+", "#")))


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: keys of fixed width keep joins and aggregates small and in generated code."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("key"), *cols)


def density_counts(c: Column) -> tuple[Column, Column, Column]:
    low = F.lower(c)
    return tuple(F.regexp_count(low, F.lit(p)) for p in (DENSE_NUMBER, DENSE_UNIT, DENSE_PERIOD))


def density(c: Column) -> Column:
    """Figures, unit and period words per 200 characters (SCL-2); 0 for empty and null."""
    n, u, p = density_counts(c)
    return F.coalesce((n + 2 * u + 2 * p) / F.greatest(F.length(c) / 200.0, F.lit(1.0)), F.lit(0.0))


def slug(c: Column) -> Column:
    """Lower case, other runs to one underscore; "unnamed" if nothing is left (SCL-5)."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("unnamed"))


def metric_tokens(c: Column) -> Column:
    """Distinct words of three letters or more that are no stop words (SCL-6)."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def cache_key(model: Column, version: Column, payload: Column) -> Column:
    """SHA-256 of the parts joined by NUL (SCL-8)."""
    nul = F.char(F.lit(0))
    return F.sha2(F.concat(model, nul, version, nul, payload), 256)


def locate(text: Column, quote: Column) -> Column:
    """Struct (start, end) of a quote in a text: as printed, else with any white space (SCL-3).

    Null where the quote is empty or does not stand in the text.
    """
    exact = F.instr(text, quote)
    needle = collapse(quote)
    parts = F.transform(F.split(needle, " "), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pattern = F.array_join(parts, SPACE + "+")
    loose = F.regexp_instr(text, pattern)
    return (F.when(F.length(needle) == 0, F.lit(None))
            .when(exact > 0, F.struct((exact - 1).alias("start"), (exact - 1 + F.length(quote)).alias("end")))
            .when(loose > 0, F.struct((loose - 1).alias("start"), (loose - 1 + F.length(F.regexp_substr(text, pattern))).alias("end"))))
