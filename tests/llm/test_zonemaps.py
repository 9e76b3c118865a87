"""Zone-map clustering against the plain rounds over all vectors, and its parts against their definitions."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoteloom.llm import zonemaps


def plain(rows, k=16, rounds=3, dim=64):
    """[(id, cluster, distance, centroid)] by definition, in whole Python numbers."""
    good = [(i, [int(np.floor(np.float64(64) * x)) for x in map(np.float64, v)]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted(good, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in seeds]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in good:
            groups.setdefault(assign(v)[1], []).append(v)
        for c, members in groups.items():
            centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return sorted(((i, c, d, tuple(centroids[c])) for (i, v) in good for d, c in [assign(v)]), key=str)


def check(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<float>, cluster int, key string, id int").repartition(3)
    got = zonemaps.cluster(table, **more).collect()
    want = plain([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows], more.get("k", 16), more.get("rounds", 3), more.get("dim", 64))
    assert sorted(((r.id, r.cluster, r.distance, tuple(r.centroid)) for r in got), key=str) == want
    sums = {}
    for _, c, d, _ in want:
        sums[c] = sums.get(c, 0) + d
    assert all(r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums.values()) for r in got)
    return got


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 64).tolist()) for i in range(60)]
    bad = [None, [], [0.5] * 63, [0.5] * 63 + [None], [float("nan")] + [0.1] * 63, [float("inf")] * 64, [float("-inf")] + [0.0] * 63]
    rows += [(100 + i, v) for i, v in enumerate(bad)] + [(None, [0.0] * 64), (7, [0.25] * 64), (7, [0.25] * 64)]
    check(spark, rows, block=8)


def test_one_vector_repeated_and_fewer_vectors_than_centroids(spark):
    check(spark, [(i, [1.0 / 3] * 64) for i in range(50)], block=4)
    check(spark, [(i, [float(i)] * 64) for i in range(5)])


def test_ties_go_to_the_smaller_number(spark):
    check(spark, [(i, [float(i % 3), float(i % 2)]) for i in range(40)], dim=2, k=4, block=3)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(6)
    check(spark, [(i, (rng.integers(-(1 << 20), 1 << 20, 64) * 1.5).tolist()) for i in range(30)], k=5, block=7)


def test_clustered_vectors_leave_few_candidates():
    rng = np.random.default_rng(7)
    centres = rng.integers(-60, 60, (16, 64))
    for c in range(16):
        m = centres[c] + rng.integers(-3, 4, (100, 64))
        assert zonemaps.candidates(m.min(axis=0), m.max(axis=0), centres).tolist() == [c]


@pytest.mark.parametrize("seed", range(4))
def test_candidates_hold_the_nearest_of_every_point(seed):
    rng = np.random.default_rng(seed)
    centroids = rng.integers(-9, 9, (12, 3))
    low = rng.integers(-9, 5, 3)
    high = low + rng.integers(0, 5, 3)
    among = zonemaps.candidates(low, high, centroids)
    for point in itertools.product(*(range(a, b + 1) for a, b in zip(low, high, strict=True))):
        x = np.array([point])
        assert [a.tolist() for a in zonemaps.nearest(x, centroids, among)] == [a.tolist() for a in zonemaps.nearest(x, centroids, np.arange(12))]


@pytest.mark.parametrize(("dims", "bits"), [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_hilbert_keys_walk_the_grid_in_steps_of_one(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in zonemaps.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    order = sorted(range(len(cells)), key=lambda i: keys[i])
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_blocks_cover_every_vector_once(spark):
    rows = spark.range(1000).select(F.col("id"), F.array(*[(F.col("id") * p % 17).cast("long") for p in (3, 5, 7)]).alias("v"))
    blocks = zonemaps.zone_maps(rows, [0] * 3, [16] * 3, block=64).collect()
    assert sorted(i for b in blocks for i in b.ids) == list(range(1000))
    for b in blocks:
        m = zonemaps._unpacked(b.matrix)
        assert len(m) == len(b.ids) <= 64 and m.min(axis=0).tolist() == b.low and m.max(axis=0).tolist() == b.high


def test_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert zonemaps.cluster(table).collect() == []
