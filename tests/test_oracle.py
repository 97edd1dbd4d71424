"""Every query with SQL against DuckDB at the smallest scale; those without must run."""

import glob
import math
from collections import Counter

import duckdb
import pytest

from ledgerloom.plans import general, reference

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {f.split('/')[-1][:-8]} as select * from '{f}'")
    return c


def _norm(v):
    return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(reference.QUERIES))
def test_query(spark, duck, name):
    df = reference.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    if name not in reference.ORACLE:
        assert cols
        return
    res = duck.execute(reference.ORACLE[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    assert got == Counter(tuple(_norm(row[names.index(c)]) for c in cols) for row in res.fetchall())


@pytest.mark.parametrize("name", sorted(general.QUERIES))
def test_general(spark, name):
    assert general.QUERIES[name](spark, D).count() > 0
