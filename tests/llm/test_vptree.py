"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoteloom.llm import vptree
from quoteloom.llm.queries import QUERIES


def brute(rows, asked, k):
    """rows of (id, vector): what each asked row's nearest are."""
    ok = sorted({(i, tuple(float(x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for q, a in ok:
        if asked(q):
            near = [(-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b)]
            out[q] = sorted(near)[:k]
    return out


def test_recall_and_scores_of_the_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 20 == 0, 20)
    got = {}
    for r in QUERIES["op9_vantage_point_neighbours"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    vectors = dict(rows)
    hits = 0
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 21))
        for _, i, s in found:
            assert s == pytest.approx(float(np.dot(np.float64(vectors[q]), np.float64(vectors[i]))), abs=1e-12)
        hits += len({f[1] for f in found} & {i for _, i in want[q]})
    assert hits >= 0.9 * 20 * len(want)


ROWS = [
    (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [-1.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [1.0, None]),
    (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0]), (11, [1.0, 2.0, 3.0]), (12, [3.0, 0.0]), (12, [3.0, 0.0]), (13, [0.0, 1.0]), (14, [1.0, -0.0]),
    (None, [5.0, 5.0]), (15, [1.0, 2.0, 4.0]),
]


@pytest.mark.parametrize("shard_rows,block_rows", [(1000, 1000), (3, 2)])
def test_ties_nulls_and_odd_vectors(spark, shard_rows, block_rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "vec_id long, embedding array<double>, rank string, score int")
    found = vptree.nearest(table, F.col("vec_id") % 2 == 0, 4, 1.0, shard_rows, block_rows).orderBy("query_id", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == brute(ROWS, lambda i: i % 2 == 0, 4)


def test_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vptree.nearest(table, F.col("vec_id") % 2 == 0).count() == 0


def test_factor_one_is_exact():
    rng = np.random.default_rng(5)
    points = rng.integers(-3, 4, (700, 5)).astype(float)  # many ties, many equal norms, different norms
    points = np.unique(points[(points != 0).any(axis=1)], axis=0)
    queries = rng.normal(size=(40, 5))
    queries[:10] = np.round(queries[:10])
    _, rows = vptree.Search(points, 7, 1.0, leaf=8).run(queries)
    scores = queries @ points.T
    for q in range(len(queries)):
        want = np.lexsort((np.arange(len(points)), -scores[q]))[:7]
        assert np.allclose(scores[q][rows[q]], scores[q][want])
        if q < 10:
            assert rows[q].tolist() == want.tolist()
