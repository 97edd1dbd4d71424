"""Whole-text parsers behind problems 3 and 4."""

import random

import numpy as np
import pytest

from ledgerloom.functions.quantities import parse_quantity
from ledgerloom.functions.timeparse import civil_from_days, days_from_civil, parse_period
from ledgerloom.operators.units_history import changepoints


@pytest.mark.parametrize("raw, order, tz, want", [
    ("FY24", "dmy", None, ("2023-04-01", "2024-03-31", "fiscal_year")),
    ("FY'23", "dmy", None, ("2022-04-01", "2023-03-31", "fiscal_year")),
    ("fiscal 2018", "dmy", None, ("2017-04-01", "2018-03-31", "fiscal_year")),
    ("2016/17", "dmy", None, ("2016-04-01", "2017-03-31", "fiscal_year")),
    ("FY 2024-2025", "dmy", None, ("2024-04-01", "2025-03-31", "fiscal_year")),
    ("12 months to 31.03.2021", "dmy", None, ("2020-04-01", "2021-03-31", "fiscal_year")),
    ("year ended December 31, 2023", "dmy", None, ("2023-01-01", "2023-12-31", "calendar_year")),
    ("Q4 FY24", "dmy", None, ("2024-01-01", "2024-03-31", "quarter")),
    ("3Q FY20", "dmy", None, ("2019-10-01", "2019-12-31", "quarter")),
    ("Jul-Sep 2019", "dmy", None, ("2019-07-01", "2019-09-30", "quarter")),
    ("9MFY2022", "dmy", None, ("2021-04-01", "2021-12-31", "part_year")),
    ("second half of FY2016", "dmy", None, ("2015-10-01", "2016-03-31", "part_year")),
    ("Feb-20", "dmy", None, ("2020-02-01", "2020-02-29", "part_year")),
    ("10/2017", "dmy", None, ("2017-10-01", "2017-10-31", "part_year")),
    ("2020", "dmy", None, ("2020-01-01", "2020-12-31", "calendar_year")),
    ("03/04/2020", "dmy", None, ("2020-04-03", "2020-04-03", "instant")),
    ("03/04/2020", "mdy", None, ("2020-03-04", "2020-03-04", "instant")),
    ("31st March 2020", "dmy", None, ("2020-03-31", "2020-03-31", "instant")),
    ("1639886454000", "dmy", None, ("2021-12-19T04:00:54Z",) * 2 + ("instant",)),
    ("20241128T021554+0000", "dmy", None, ("2024-11-28T02:15:54Z",) * 2 + ("instant",)),
    ("2017-03-26T03:50:00.9+02:00", "dmy", None, ("2017-03-26T01:50:00Z",) * 2 + ("instant",)),
    ("as of March 28, 2021 2:19 a.m. BST", "dmy", None, ("2021-03-28T01:19:00Z",) * 2 + ("instant",)),
    ("12/27/2016 8:09 PM", "mdy", "America/New_York", ("2016-12-28T01:09:00Z",) * 2 + ("instant",)),
    ("as on 27 March 2021, 20:24 hrs", "dmy", "Asia/Kolkata", ("2021-03-27T14:54:00Z",) * 2 + ("instant",)),
    ("recently", "dmy", None, None), ("", "dmy", None, None), (None, "dmy", None, None),
    ("30 February 2020", "dmy", None, None), ("25:61 2020-01-01", "dmy", None, None), ("2016-19", "dmy", None, None),
])
def test_period(raw, order, tz, want):
    assert parse_period(raw, order, tz) == want


def test_integer_days_round_trip():
    for d in [*range(-1000, 1000, 7), *(random.Random(1).randrange(-200000, 900000) for _ in range(500))]:
        assert days_from_civil(*civil_from_days(d)) == d
    assert days_from_civil(1970, 1, 1) == 0 and days_from_civil(2000, 3, 1) == 11017


@pytest.mark.parametrize("value, unit, quote, want", [
    ("81,415.38", "₹ in Million", None, (81415380000.0, "INR")),
    ("1,70,260.8", "INR mio", None, (170260800000.0, "INR")),
    ("8,142", "I in million", None, (8142e6, "INR")),
    ("5,156", "(` in Crore)", None, (5156e7, "INR")),
    ("3", "₹ lakh crore", None, (3e12, "INR")),
    ("(452)", "₹ Cr", None, (-452e7, "INR")),
    ("−703.3", "basis points", None, (-7.033, "PERCENT")),
    ("74.6‰", None, None, (7.46, "PERCENT")),
    ("1 019 bps", None, None, (10.19, "PERCENT")),
    ("5 728 052", "₹ in thousands", None, (5728052e3, "INR")),
    ("1.234,5", "kg", None, (1.2345, "TONNE")),
    ("19,174", "quintals", None, (1917.4, "TONNE")),
    ("388.9", "hrs", None, (388.9 / 24, "DAYS")),
    ("13", "dozen parcels", None, (156.0, "COUNT")),
    ("Rs 216,429.81 ('000)", None, None, (216429810.0, "INR")),
    ("29 432 203", "US cents", None, (294322.03, "USD")),
    ("१०.४", "₹ Cr", None, (10.4e7, "INR")),
    ("93.53", None, "reached 93.53 crore rupees (09/11/2019), against ₹ 901 crore", (93.53e7, "INR")),
    ("7.954", "lakh", "came to 7.954 lakh customers at X", (795400.0, "COUNT")),
    ("13.5", None, "margin was 13.5 in respect of FY17, excluding $ 5 mn of grants", (13.5, "UNKNOWN")),
    ("substantially higher", "₹ Cr", None, (None, None)), (None, "₹", "₹ 5", (None, None)), ("", "", "", (None, None)),
])
def test_quantity(value, unit, quote, want):
    got = parse_quantity(value, unit, quote)
    assert got[1] == want[1] and got[0] == (want[0] if want[0] is None else pytest.approx(want[0], rel=1e-12))


def _brute(x, penalty):
    n = len(x)
    best, back = [-penalty] + [np.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(j):
            s = np.array(x[i:j])
            c = best[i] + ((s - s.mean()) ** 2).sum() + penalty
            if c < best[j] - 1e-12:
                best[j], back[j] = c, i
    return best[n]


def test_changepoints_are_optimal():
    r = np.random.default_rng(3)
    for _ in range(60):
        x = np.round(np.repeat(r.integers(-3, 4, 6), r.integers(1, 5, 6)) + r.choice([0, 0.3], 1) * r.integers(0, 2, 1), 1).astype(float)
        p = float(r.choice([0.05, 0.7, 3.0]))
        starts = list(changepoints(x, p)) + [len(x)]
        cost = sum(((x[a:b] - x[a:b].mean()) ** 2).sum() + p for a, b in zip(starts, starts[1:])) - p
        assert cost == pytest.approx(_brute(list(x), p), abs=1e-9)
    assert len(changepoints(np.zeros(0), 1.0)) == 0
