"""Every query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from framewise.registry import ORACLE_SQL, QUERIES

from .conftest import DATA


def plain(v):
    if v is None or (not isinstance(v, str) and pd.isna(v)):
        return None
    return round(float(v), 6) + 0.0 if not isinstance(v, (str, bool)) and not hasattr(v, "isoformat") and str(v) not in ("True", "False") else str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        assert rows(got) == rows(duck.execute(ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
