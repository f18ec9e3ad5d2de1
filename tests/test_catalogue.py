"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from kelpforge.plans import catalogue

DIR = "/root/testdata/sf0.001"


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr([shown(x) for x in v]) if isinstance(v, (list, tuple)) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DIR).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rows = sorted([shown(r[c]) for c in cols] for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    assert rows == sorted([shown(r[names.index(c)]) for c in cols] for r in found.fetchall())
