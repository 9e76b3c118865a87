"""SimHash near-dedup against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quoteloom.llm import simhash
from quoteloom.llm.queries import QUERIES


def plain_fingerprint(text):
    words, word = [], ""
    for ch in text or "":
        if ch in " \t\n\v\f\r":
            words, word = (words + [word] if word else words), ""
        else:
            word += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    words = words + [word] if word else words
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(ids, values, radius=4):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    v = np.array(values, np.uint64)
    for i in range(len(v)):
        for j in np.nonzero(np.bitwise_count(v[i] ^ v[:i]) <= radius)[0]:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, doc in enumerate(ids):
        r = root(i)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return [least.get(root(i)) for i in range(len(ids))]


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op1_simhash_dedup"](spark, sf).collect()}
    ids = [d.doc_id for d in docs]
    values = [plain_fingerprint(d.text) for d in docs]
    want = plain_components(ids, values)
    assert len(got) == len(docs)
    for doc, value, component in zip(ids, values, want, strict=True):
        assert got[doc].fingerprint == f"{value:016x}"
        assert got[doc].component_id == component
    assert any(c != d for c, d in zip(want, ids, strict=True))


ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (None, "one two"), (6, "É é a b c"), (6, "É é a b c"),
    (7, "word " * 70_000), (8, "word " * 69_999), (9, "x y z"),
]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(*r, "keep", 1) for r in ROWS], "doc_id long, text string, root string, fp int")
    got = simhash.near_duplicates(docs).select("doc_id", "fp", "component_id").collect()
    values = [plain_fingerprint(t) for _, t in ROWS]
    want = plain_components([i for i, _ in ROWS], values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(zip([i for i, _ in ROWS], signed, want, strict=True), key=key)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(c for c in want if c is not None))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_every_close_pair_is_linked(spark, radius):
    """Also through crowded buckets: a bucket bound of 3 sends most values through shared points."""
    rng = np.random.default_rng(radius)
    seeds = rng.integers(0, 2**64, 6, dtype=np.uint64)
    values = set()
    for s in seeds:
        for _ in range(25):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            s = np.uint64(int(s) ^ sum(1 << int(b) for b in flips))
            values.add(int(s))
    values = sorted(values)
    table = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    want = plain_components(values, values, radius)
    for bucket in (3, 256):
        roots = simhash.components(simhash.links(table, radius, bucket)).collect()
        found = {r.node % (1 << 64): r.root % (1 << 64) for r in roots}
        groups, expected = {}, {}
        for v, w in zip(values, want, strict=True):
            groups.setdefault(found.get(v, v), set()).add(v)
            expected.setdefault(w, set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_hash_is_the_published_one(spark):
    row = spark.sql("select xxhash64('one two three four') h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"one two three four", 42)
    assert F is not None
