"""Every registered query against its SQL twin (or, without one, for rows and a stable schema)."""

import math

import duckdb
import pandas as pd
import pytest

from quoteloom.catalog import load
from quoteloom.catalog.registry import ORACLES, QUERIES

load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame(index=df.index)
    for name in sorted(df.columns):
        col = df[name]
        if col.map(lambda v: v is None or v is pd.NA or isinstance(v, (int, float, bool)) or hasattr(v, "dtype")).all():
            out[name] = pd.to_numeric(col, errors="coerce").astype(float)
        else:
            out[name] = col.map(lambda v: "" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v))
    return out.sort_values(list(out.columns), na_position="first").reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    frame = got.toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name not in ORACLES:
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(frame.columns) == sorted(want.columns)
    a, b = normal(frame), normal(want)
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype == float and b[c].dtype == float:
            same = ((a[c] - b[c]).abs() <= 2e-6 + 1e-12 * b[c].abs()) | (a[c].isna() & b[c].isna())
        else:
            same = a[c].astype(str) == b[c].astype(str)
        assert same.all(), f"{name}.{c}: {(~same).sum()} rows differ"


def test_most_queries_have_a_twin():
    assert len(ORACLES) >= 0.9 * len(QUERIES)
