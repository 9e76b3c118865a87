"""Every corpus query against its SQL twin at the smallest scale."""

import duckdb
import pytest

from quoteloom.llm.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows):
    return sorted(tuple((v is not None, f"{v:.9g}" if isinstance(v, float) else str(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    assert rows
    if ORACLES.get(name):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]}) q").fetchall()
        assert normal(rows) == normal(want)
