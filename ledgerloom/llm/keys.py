"""Canonical text keys as Column expressions, and 128-bit keys of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Devanagari digits and the characters that stand for a minus.
_DEVANAGARI = "०१२३४५६७८९"
_MINUS = "−–‑‐"


def line_key(text: Column) -> Column:
    """Lines equal but for case, whitespace, punctuation and the digits of numbers get one key."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{Nd}]+", ""), r"\p{Nd}+", "0")


def content_tokens(text: Column, grouped: bool = False) -> Column:
    """Words and numbers of a text: no case, punctuation or thousands separators.

    Digits, decimal points and signs stay; a number in brackets is a negative
    number; currency and percent marks stay.  With ``grouped`` numbers fall
    into their groups of three digits: as a bag they are the same whether a
    space separates thousands ("12 500") or two numbers that stand side by side
    ("resolution 7 435.8").
    """
    s = F.lower(F.translate(text, _DEVANAGARI + _MINUS, "0123456789" + "-" * len(_MINUS)))
    s = F.regexp_replace(s, r"(?U)(?<=\d),(?=\d)|(?<=\d)['’](?=\d{3})|(?<=(?<!\d)\d{1,3})\s{1,4}(?=\d{3}(?!\d))", "")
    s = F.regexp_replace(s, r"(?U)\(\s*([₹$]?\s*)-?(\d[\d.]*)\s*\)", r" $1 -$2 ")
    # a hyphen inside a word, date or range is no sign
    s = F.regexp_replace(s, r"(?<=[\p{L}\p{Nd}])-", " ")
    if grouped:
        s = F.regexp_replace(s, r"(?<=\p{Nd})(?=(?:\p{Nd}{3})+(?!\p{Nd}))", " ")
    return F.regexp_extract_all(s, F.lit(r"-?\p{Nd}+(?:\.\p{Nd}+)*|[\p{L}\p{M}]+|[₹$%‰€£]"), F.lit(0))


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes; fixed-width keys keep aggregation in generated code."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("ledger"), *cols, F.lit("loom"))
