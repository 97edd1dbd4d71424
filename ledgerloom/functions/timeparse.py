"""One-pass parser for stated periods, dates and clock times.

Every known notation is one alternative of a single compiled regex with named
groups.  A text is matched once, the components are read from the alternative
that matched, calendar ranges are validated, and days and instants are put
together by integer day arithmetic (days and seconds since 1970-01-01).

Results: ``(period_start, period_end, period_kind)`` or ``None`` when the text
states no definite period.  Null, empty and blank texts give ``None``; dates
that do not exist give ``None``.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

# English month names and their abbreviations.
MONTHS = ("january february march april may june july august september "
          "october november december").split()
MONTH_NO = {name: i + 1 for i, name in enumerate(MONTHS)}
MONTH_NO |= {name[:3]: i + 1 for i, name in enumerate(MONTHS)} | {"sept": 9}

# Zone abbreviations and their distance from UTC in minutes.
ZONE_MINUTES = {"utc": 0, "z": 0, "gmt": 0, "bst": 60, "cet": 60, "cest": 120,
                "est": -300, "edt": -240, "ist": 330, "sgt": 480, "gst": 240}
#: Abbreviations that name the wall clock of a place.
ZONE_PLACE = {"est": "America/New_York", "edt": "America/New_York",
              "gmt": "Europe/London", "bst": "Europe/London",
              "cet": "Europe/Berlin", "cest": "Europe/Berlin"}
# Number words of spans.
SPAN_MONTHS = {"three months": 3, "quarter": 3, "six months": 6, "half year": 6,
               "half-year": 6, "nine months": 9, "twelve months": 12, "year": 12,
               "12 months": 12, "9 months": 9, "6 months": 6, "3 months": 3}


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 of a proleptic Gregorian date."""
    y -= m <= 2
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def civil_from_days(z: int) -> tuple[int, int, int]:
    """Inverse of :func:`days_from_civil`."""
    z += 719468
    era = z // 146097
    doe = z - era * 146097
    yoe = (doe - doe // 1460 + doe // 36524 - doe // 146096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    m = mp + (3 if mp < 10 else -9)
    return yoe + era * 400 + (m <= 2), m, doy - (153 * mp + 2) // 5 + 1


def month_days(y: int, m: int) -> int:
    return (days_from_civil(y + m // 12, m % 12 + 1, 1) - days_from_civil(y, m, 1))


def _valid(y: int, m: int, d: int) -> bool:
    return 1000 <= y <= 9999 and 1 <= m <= 12 and 1 <= d <= month_days(y, m)


def iso_day(days: int) -> str:
    return "%04d-%02d-%02d" % civil_from_days(days)


def iso_instant(seconds: int) -> str:
    days, rest = divmod(seconds, 86400)
    return "%sT%02d:%02d:%02dZ" % (iso_day(days), rest // 3600, rest // 60 % 60, rest % 60)


_MON = "(?:" + "|".join(sorted(MONTH_NO, key=len, reverse=True)) + r")\.?"
_FY = r"(?:fy|fiscal(?:\s*year)?|financial\s*year)\s*'?\s*"
_YR = r"(?:\d{4}|\d{2})"
_LEAD = r"(?:as\s+(?:on|of|at)\s+|on\s+)?"
_CLOCK12 = r"(?P<{0}H>\d{{1,2}}):(?P<{0}M>\d{{2}})(?::(?P<{0}S>\d{{2}}))?\s*(?P<{0}ap>[ap]\.?\s?m\.?)"
_CLOCK24 = r"(?P<{0}H>\d{{1,2}}):(?P<{0}M>\d{{2}})(?::(?P<{0}S>\d{{2}})(?:[.,]\d+)?)?(?:\s*(?:hrs|hours|h))?"
_ZONE = r"(?:\s*(?P<{0}z>z|utc|gmt|bst|cet|cest|est|edt|ist|sgt|gst)?(?:\s*(?P<{0}o>[+-]\d{{2}}:?\d{{2}}))?)"


def _date(p: str, numeric_slash: bool = True) -> str:
    """Sub-alternatives of one day, groups prefixed by p and a letter each."""
    forms = [
        rf"(?P<{p}ay>\d{{4}})-(?P<{p}am>\d{{1,2}})-(?P<{p}ad>\d{{1,2}})",
        rf"(?P<{p}bd>\d{{1,2}})\.(?P<{p}bm>\d{{1,2}})\.(?P<{p}by>\d{{4}})",
        rf"(?P<{p}cd>\d{{1,2}})(?:st|nd|rd|th)?(?:\s+|-)(?P<{p}cn>{_MON})(?:\s+|-|,\s*)(?P<{p}cy>{_YR})",
        rf"(?P<{p}dn>{_MON})\s+(?P<{p}dd>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<{p}dy>\d{{4}})",
        rf"(?P<{p}ey>\d{{4}})(?P<{p}em>\d{{2}})(?P<{p}ed>\d{{2}})",
    ]
    if numeric_slash:
        forms.append(rf"(?P<{p}f1>\d{{1,2}})/(?P<{p}f2>\d{{1,2}})/(?P<{p}fy>\d{{4}})")
    return "(?:" + "|".join(forms) + ")"


_ALTERNATIVES = [
    ("epoch", r"(?P<ep>\d{10}|\d{13})"),
    ("stamp", _LEAD + _date("s") + r"(?:t|,?\s+(?:at\s+)?)(?:" + _CLOCK12.format("k") + "|" + _CLOCK24.format("l") + ")" + _ZONE.format("s")),
    ("basic", r"(?P<xy>\d{4})(?P<xm>\d{2})(?P<xd>\d{2})t(?P<xH>\d{2})(?P<xM>\d{2})(?P<xS>\d{2})?(?:[.,]\d+)?" + _ZONE.format("x")),
    ("quarter", rf"(?:(?:q(?P<q1>[1-4])|(?P<q2>[1-4])q|(?P<q3>first|second|third|fourth)\s+quarter)\s*(?:of\s+|,\s*)?(?:{_FY})?(?P<qy>\d{{4}}|\d{{2}})(?:[-/](?P<qz>{_YR}))?"
                rf"|{_FY}(?P<qw>{_YR})(?:[-/](?P<qv>{_YR}))?\s*,?\s*(?:q(?P<q4>[1-4])|(?P<q5>[1-4])q))"),
    ("part", rf"(?:(?P<ph>h[12]|[12]h|9m|first\s+half|second\s+half|nine\s+months)\s*(?:of\s+)?(?:{_FY})(?P<py>{_YR})(?:[-/](?P<pz>{_YR}))?"
             rf"|{_FY}(?P<pw>{_YR})(?:[-/](?P<pv>{_YR}))?\s*(?P<pg>h[12]|[12]h|9m))"),
    ("fiscal", rf"{_FY}(?P<fy1>{_YR})(?:\s*[-/]\s*(?P<fy2>{_YR}))?"),
    ("pair", rf"(?P<p1>\d{{4}})\s*[-/–]\s*(?P<p2>\d{{4}}|\d{{2}})"),
    ("span", r"(?:the\s+)?(?P<sw>" + "|".join(sorted((k.replace(" ", r"\s+") for k in SPAN_MONTHS), key=len, reverse=True)) + r")\s+(?:ended|ending|to)\s+" + _date("e")),
    ("calendar", r"(?:(?:cy|calendar\s+year)\s*'?\s*(?P<c1>\d{4}|\d{2})|(?P<c2>(?:19|20)\d{2}))"),
    ("months", rf"(?P<m1>{_MON})\s*(?:-|–|to)\s*(?P<m2>{_MON})\s+(?P<my>\d{{4}})"),
    ("month", rf"(?:month\s+of\s+)?(?P<n1>{_MON})(?:,?\s+|-|')(?P<ny>{_YR})|(?P<n2>\d{{1,2}})/(?P<nz>\d{{4}})"),
    ("day", _LEAD + _date("d")),
]
PATTERN = re.compile("(?:" + "|".join(f"(?P<{name}_>{body})" for name, body in _ALTERNATIVES) + r")\s*\Z")
_SPACE = re.compile(r"\s+")


def _year(text: str) -> int:
    y = int(text)
    return y if len(text) == 4 else 2000 + y


def _fiscal_end(first: str, second: str | None) -> int | None:
    """Year in which a fiscal year ends; a pair must be consecutive."""
    if second is None:
        return _year(first)
    a = _year(first)
    b = int(second) if len(second) == 4 else a - a % 100 + int(second) + (100 if int(second) < a % 100 else 0)
    return b if b == a + 1 else None


def _day_of(g: dict, p: str, order: str | None) -> tuple[int, int, int] | None:
    for k in "abcde":
        if g.get(f"{p}{k}y"):
            y = _year(g[f"{p}{k}y"])
            m = g.get(f"{p}{k}m")
            m = int(m) if m else MONTH_NO[g[f"{p}{k}n"].rstrip(".")]
            d = int(g[f"{p}{k}d"])
            return (y, m, d) if _valid(y, m, d) else None
    if g.get(f"{p}fy"):
        y, a, b = int(g[f"{p}fy"]), int(g[f"{p}f1"]), int(g[f"{p}f2"])
        first, other = ((y, a, b), (y, b, a)) if order == "mdy" else ((y, b, a), (y, a, b))
        return first if _valid(*first) else other if _valid(*other) else None
    return None


@lru_cache(maxsize=64)
def _zone(name: str) -> ZoneInfo:
    return ZoneInfo(name)


def _local_offset(seconds: int, name: str) -> int:
    """Offset in seconds of a wall-clock reading; the first of two readings."""
    wall = datetime(1970, 1, 1) + timedelta(seconds=seconds)
    return int(wall.replace(tzinfo=_zone(name)).utcoffset().total_seconds())


def _span(y: int, m: int, n: int) -> tuple[str, str, str]:
    """Span of n whole months that ends with month m of year y."""
    s = y * 12 + m - n
    kind = "part_year"
    if n == 3 and m % 3 == 0:
        kind = "quarter"
    elif n == 12 and m == 3:
        kind = "fiscal_year"
    elif n == 12 and m == 12:
        kind = "calendar_year"
    return (iso_day(days_from_civil(s // 12, s % 12 + 1, 1)),
            iso_day(days_from_civil(y, m, month_days(y, m))), kind)


def parse_period(raw: str | None, order: str | None = "dmy", tz: str | None = "UTC"):
    """``(start, end, kind)`` of a stated period, or None."""
    if not raw:
        return None
    m = PATTERN.match(_SPACE.sub(" ", raw).strip().lower())
    if m is None:
        return None
    kind, g = m.lastgroup[:-1], {k: v for k, v in m.groupdict().items() if v is not None}
    if kind == "epoch":
        s = int(g["ep"])
        s = s // 1000 if len(g["ep"]) == 13 else s
        t = iso_instant(s)
        return t, t, "instant"
    if kind in ("stamp", "basic"):
        return _instant(g, kind, order, tz)
    if kind == "quarter":
        q = g.get("q1") or g.get("q2") or g.get("q4") or g.get("q5")
        q = int(q) if q else ("first", "second", "third", "fourth").index(g["q3"]) + 1
        y = _fiscal_end(g.get("qy") or g["qw"], g.get("qz") or g.get("qv"))
        return None if y is None else _span(y - (q < 4), (6, 9, 12, 3)[q - 1], 3)
    if kind == "part":
        y = _fiscal_end(g.get("py") or g["pw"], g.get("pz") or g.get("pv"))
        w = g.get("ph") or g["pg"]
        if y is None:
            return None
        if w[0] == "9" or w[0] == "n":
            return _span(y - 1, 12, 9)
        return _span(y - 1, 9, 6) if "1" in w or w[0] == "f" else _span(y, 3, 6)
    if kind == "fiscal":
        y = _fiscal_end(g["fy1"], g.get("fy2"))
        return None if y is None else _span(y, 3, 12)
    if kind == "pair":
        y = _fiscal_end(g["p1"], g["p2"])
        return None if y is None else _span(y, 3, 12)
    if kind == "span":
        d = _day_of(g, "e", order)
        if d is None or d[2] != month_days(d[0], d[1]):
            return None
        return _span(d[0], d[1], SPAN_MONTHS[g["sw"]])
    if kind == "calendar":
        return _span(_year(g.get("c1") or g["c2"]), 12, 12)
    if kind == "months":
        a, b, y = MONTH_NO[g["m1"].rstrip(".")], MONTH_NO[g["m2"].rstrip(".")], int(g["my"])
        return None if b < a else _span(y, b, b - a + 1)
    if kind == "month":
        if "n1" in g:
            return _span(_year(g["ny"]), MONTH_NO[g["n1"].rstrip(".")], 1)
        return _span(int(g["nz"]), int(g["n2"]), 1) if 1 <= int(g["n2"]) <= 12 else None
    d = _day_of(g, "d", order)
    if d is None:
        return None
    t = iso_day(days_from_civil(*d))
    return t, t, "instant"


def _instant(g: dict, kind: str, order: str | None, tz: str | None):
    if kind == "stamp":
        d = _day_of(g, "s", order)
        p = "k" if "kH" in g else "l"
        zone, off = g.get("sz"), g.get("so")
    else:
        d, p = (int(g["xy"]), int(g["xm"]), int(g["xd"])), "x"
        zone, off = g.get("xz"), g.get("xo")
    if d is None or not _valid(*d):
        return None
    h, mi, s = int(g[p + "H"]), int(g[p + "M"]), int(g.get(p + "S", 0))
    if p == "k":
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if g["kap"][0] == "p" else 0)
    if h > 23 or mi > 59 or s > 59:
        return None
    sec = days_from_civil(*d) * 86400 + h * 3600 + mi * 60 + s
    if off:
        o = off.replace(":", "")
        sec -= (1 if o[0] == "+" else -1) * (int(o[1:3]) * 3600 + int(o[3:5]) * 60)
    elif zone:
        sec -= ZONE_MINUTES[zone] * 60
    else:
        try:
            sec -= _local_offset(sec, tz or "UTC")
        except (KeyError, ValueError, OSError):
            return None
    t = iso_instant(sec)
    return t, t, "instant"
