"""Quantities in many notations to one common unit by plain arithmetic.

``parse_quantity(value_raw, unit_raw, quote)`` gives ``(value, unit)``; both
None when ``value_raw`` holds no number.  Units: INR, USD, PERCENT, TONNE,
DAYS, COUNT and UNKNOWN (scaled number).  The quote is consulted only where
the fact itself names no unit, and in it only the text that touches the fact's
own number.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Scale words.
SCALES = {
    "thousand": 1e3, "thousands": 1e3, "k": 1e3, "'000": 1e3, "’000": 1e3, "000": 1e3,
    "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5,
    "million": 1e6, "millions": 1e6, "mn": 1e6, "mio": 1e6, "m": 1e6,
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "crs": 1e7,
    "billion": 1e9, "billions": 1e9, "bn": 1e9,
    "trillion": 1e12, "trillions": 1e12, "tn": 1e12,
    "dozen": 12.0, "dozens": 12.0,
}
# Unit words with their unit and factor.
UNITS = {
    "₹": ("INR", 1.0), "rs": ("INR", 1.0), "rs.": ("INR", 1.0), "inr": ("INR", 1.0),
    "rupee": ("INR", 1.0), "rupees": ("INR", 1.0),
    "$": ("USD", 1.0), "us$": ("USD", 1.0), "usd": ("USD", 1.0), "dollar": ("USD", 1.0), "dollars": ("USD", 1.0),
    "cent": ("USD", 0.01), "cents": ("USD", 0.01), "paise": ("INR", 0.01),
    "%": ("PERCENT", 1.0), "percent": ("PERCENT", 1.0), "pct": ("PERCENT", 1.0),
    "percentage": ("PERCENT", 1.0), "‰": ("PERCENT", 0.1), "mille": ("PERCENT", 0.1),
    "bps": ("PERCENT", 0.01), "bp": ("PERCENT", 0.01), "basis": ("PERCENT", 0.01),
    "t": ("TONNE", 1.0), "ton": ("TONNE", 1.0), "tons": ("TONNE", 1.0), "tonne": ("TONNE", 1.0),
    "tonnes": ("TONNE", 1.0), "mt": ("TONNE", 1.0), "kt": ("TONNE", 1e3), "kg": ("TONNE", 1e-3),
    "kgs": ("TONNE", 1e-3), "kilogram": ("TONNE", 1e-3), "kilograms": ("TONNE", 1e-3),
    "quintal": ("TONNE", 0.1), "quintals": ("TONNE", 0.1),
    "day": ("DAYS", 1.0), "days": ("DAYS", 1.0), "week": ("DAYS", 7.0), "weeks": ("DAYS", 7.0),
    "fortnight": ("DAYS", 14.0), "fortnights": ("DAYS", 14.0),
    "hour": ("DAYS", 1 / 24), "hours": ("DAYS", 1 / 24), "hr": ("DAYS", 1 / 24), "hrs": ("DAYS", 1 / 24),
    "minute": ("DAYS", 1 / 1440), "minutes": ("DAYS", 1 / 1440), "min": ("DAYS", 1 / 1440), "mins": ("DAYS", 1 / 1440),
    "unit": ("COUNT", 1.0), "units": ("COUNT", 1.0), "nos": ("COUNT", 1.0), "no": ("COUNT", 1.0),
}
# Words that carry neither scale nor unit beside a number.
FILLERS = {"in", "of", "about", "approx", "approx.", "around", "nearly", "some", "roughly", "circa", "ca",
           "ca.", "over", "almost", "us", "per", "points", "point", "c", "c.", "the", "a", "~", "c"}
#: Characters that stand for a damaged rupee mark before a scale word.
DAMAGED = {"i", "`", "¹", "¦"}

_SIGN = "\\-\u2212\u2013\u2010\u2011"
_SPACES = " \u00a0\u202f\u2009'\u2019"
_SEP = _SPACES
_DIGITS = rf"\d+(?:[,.]\d+|[{_SPACES}]\d{{3}}(?!\d))*"
NUMBER = re.compile(rf"(?P<open>\(\s*)?(?P<sign>[{_SIGN}]\s?)?(?P<open2>\(\s*)?(?P<digits>{_DIGITS}|\.\d+)(?P<close>\s*\))?")
_THOUSAND = re.compile(r"\(?\s*['’]0{3}\b\s*\)?", re.I)
_TOKEN = re.compile(r"us\s?\$|rs\.|nos\.|['’]000|[₹$%‰`¹¦~]|[^\W\d_]+\.?")
_DEVANAGARI = {0x966 + i: 0x30 + i for i in range(10)}


def plain_number(digits: str) -> float | None:
    """Value of a digit string; the last of comma and point is the decimal mark."""
    s = digits.translate(_DEVANAGARI)
    for ch in _SEP:
        s = s.replace(ch, "")
    comma, point = s.rfind(","), s.rfind(".")
    if comma >= 0 and point >= 0:
        s = s.replace(",", "") if point > comma else s.replace(".", "").replace(",", ".")
    elif comma >= 0:
        s = s.replace(",", "")
    elif s.count(".") > 1:
        s = s.replace(".", "")
    try:
        return float(s)
    except ValueError:
        return None


@lru_cache(maxsize=20000)
def unit_words(text: str) -> tuple[float, str | None, float, bool]:
    """``(scale, unit, unit factor, named)`` of the words beside a number.

    named tells whether the words name a unit; unit is UNKNOWN otherwise.
    """
    toks = [t for t in _TOKEN.findall(text.lower())]
    scale, unit, factor, other = 1.0, None, 1.0, False
    for i, t in enumerate(toks):
        bare = t.rstrip(".")
        nxt = toks[i + 1:]
        if t in DAMAGED and any(x.rstrip(".") in SCALES for x in nxt[:2]):
            unit, factor = "INR", 1.0
        elif bare == "per" and nxt and nxt[0].rstrip(".") in ("cent", "mille"):
            unit, factor = "PERCENT", 1.0 if nxt[0].startswith("cent") else 0.1
            break
        elif t.replace(" ", "") in UNITS or bare in UNITS:
            if unit is None or bare in ("cents", "cent"):
                unit, factor = UNITS.get(t.replace(" ", "")) or UNITS[bare]
        elif t in SCALES or bare in SCALES:
            scale *= SCALES.get(t) or SCALES[bare]
        elif t not in FILLERS and bare not in FILLERS:
            other = True
    if unit is None:
        return scale, "COUNT" if other else "UNKNOWN", 1.0, other
    return scale, unit, factor, True


def split_value(value_raw: str | None):
    """``(number, rest of the text)`` of a raw value, or None without a number."""
    if not value_raw:
        return None
    text = _THOUSAND.sub(" thousand ", value_raw)
    best = NUMBER.search(text)
    if best is None:
        return None
    v = plain_number(best["digits"])
    if v is None:
        return None
    if best["sign"] or ((best["open"] or best["open2"]) and best["close"]):
        v = -v
    return v, text[:best.start()] + " " + text[best.end():]


def states_unit(value_raw: str | None, unit_raw: str | None) -> bool:
    s = split_value(value_raw)
    return s is not None and unit_words((s[1] + " " + _THOUSAND.sub(" thousand ", unit_raw or "")).strip())[3]


# Things that are counted.
COUNTED = {"customers", "employees", "warehouses", "branches", "incidents", "patents", "vehicles", "postcodes",
           "parcels", "units", "nos", "shipments", "orders", "stores", "accounts", "people", "items"}
_AFTER = re.compile(r"\s*[(]?\s*(us\s?\$|['’]000|[₹$%‰`]|[^\W\d_]+\.?)", re.I)
# a unit in letters is a word of its own: "customers 12" and "hours 12" name no rupees
_BEFORE = re.compile(r"((?:(?<![^\W_])(?:us\s?\$|usd|inr|rs\.?|i)|[₹$`¹¦])\s*)[(]?\s*$", re.I)
#: What follows or precedes a number inside a date, a clock time or a name of letters and digits.
_IN_DATE = re.compile(r"[-/:]\d|[tT]\d")
_DATE_BEFORE = re.compile(r"\d[-/:+tT]?$")


def _readings(m: re.Match) -> list[tuple[str, int, int]]:
    """``(digits, start, end)`` of a number as matched, and of its parts where spaces may separate two numbers."""
    digits, at = m["digits"], m.start("digits")
    out = [(digits, at, m.end())]
    for gap in re.finditer(rf"[{_SPACES}]", digits):
        out.append((digits[gap.end():], at + gap.end(), m.end()))
        out.append((digits[:gap.start()], at, at + gap.start()))
    return out


def quote_unit(number: float, quote: str | None):
    """``(scale, unit, factor, named)`` of the words that touch the number in a quote.

    White space runs count as one space.  Of the places where the number
    stands, the first that names a unit counts; numbers of dates, clock times
    and longer codes are no places.
    """
    if not quote:
        return None
    text = _THOUSAND.sub(" thousand ", " ".join(quote.split()))
    scaled = None
    for m in NUMBER.finditer(text):
        for digits, start, end in _readings(m):
            v = plain_number(digits)
            if v is None or abs(v - abs(number)) > 1e-9 * max(1.0, abs(number)):
                continue
            lead = start if digits != m["digits"] else m.start()
            if _IN_DATE.match(text, end) or _DATE_BEFORE.search(text, max(0, lead - 2), lead) and text[lead - 1] != " ":
                continue
            before = _BEFORE.search(text[max(0, lead - 12):lead])
            words, at = [], end
            while (w := _AFTER.match(text, at)) and len(words) < 4:
                t = w[1].lower().replace(" ", "")
                bare = t.rstrip(".")
                if not (t in UNITS or bare in UNITS or t in SCALES or bare in SCALES or bare in COUNTED
                        or bare in ("us", "per", "points", "point")):
                    break
                words.append(w[1])
                at = w.end()
            scale, unit, factor, named = unit_words(((before[1] if before else "") + " " + " ".join(words)).strip())
            if named:
                return scale, unit, factor, named
            if scale != 1.0 and scaled is None:
                scaled = scale, unit, factor, named
    return scaled


def read_quantity(value_raw: str | None, unit_raw: str | None, quote: str | None = None):
    """``(printed number, value, unit)``; three None without a number."""
    s = split_value(value_raw)
    if s is None:
        return None, None, None
    v, rest = s
    scale, unit, factor, named = unit_words((rest + " " + _THOUSAND.sub(" thousand ", unit_raw or "")).strip())
    if not named and quote:
        q = quote_unit(v, quote)
        if q is not None and q[3]:
            unit, factor = q[1], q[2]
            if scale == 1.0:
                scale = q[0]
    return v, v * scale * factor, unit


def parse_quantity(value_raw: str | None, unit_raw: str | None, quote: str | None = None):
    return read_quantity(value_raw, unit_raw, quote)[1:]
