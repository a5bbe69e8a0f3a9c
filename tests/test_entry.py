import math
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(df):
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "-"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return Counter(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


CORE = sorted(n for n in entry.catalogue.queries())


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    if name in entry.oracle_sql():
        want = duck.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
