"""The n-gram trie against plain dictionaries, and its sequences against NumPy."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quoteloom.llm import eliasfano, trie
from quoteloom.llm.queries import QUERIES


@pytest.mark.parametrize("n,u", [(0, 10), (1, 1), (5, 5), (1000, 50), (1000, 1000), (20000, 1 << 40), (60000, 1 << 22), (9000, 10000)])
def test_sequences(tmp_path, n, u):
    rng = np.random.default_rng(n)
    v = rng.integers(0, u, n)
    if n > 5000:
        v[:300] = rng.integers(0, min(u, 400), 300)
        v[300:4000] = rng.integers(0, u // 50 + 1, 3700)  # a dense stretch
    v = np.sort(v)
    for by_position in (False, True):
        arrays, meta = eliasfano.encode("x", v, u, by_position)
        eliasfano.save(f"{tmp_path}/f", arrays, {"x": meta})
        back, meta = eliasfano.load(f"{tmp_path}/f")
        e = eliasfano.EliasFano(back, "x", meta["x"])
        if by_position:
            assert (e.get(np.arange(n)) == v).all()
        else:
            q = np.concatenate([rng.integers(0, u, 2000), v])
            w = np.searchsorted(v, q)
            got, there = e.find(q), (w < n) & (v[np.minimum(w, n - 1)] == q) if n else np.zeros(len(q), bool)
            assert ((got >= 0) == there).all() and (v[got[there]] == q[there]).all()


def plain(rows, discount=trie.DISCOUNT):
    """The same model over dictionaries: (held_out, n_tokens, n_known, N, base, score) per row."""

    def code(p):
        return 10 ** (-trie.STEP * min(255, max(0, round(-math.log10(p) / trie.STEP))))

    def words(text):
        return [w.decode() for w in (text or "").encode().lower().split()]

    out = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    seqs = [[None, *words(t), None] for _, t in rows]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for held, s in zip(out, seqs, strict=True):
        if not held:
            c1.update(s[1:])
            c2.update(zip(s, s[1:], strict=False))
            c3.update(zip(s, s[1:], s[2:], strict=False))
    t1, t2 = Counter(k[0] for k in c2), Counter(k[:2] for k in c3)
    n, v, got = sum(c1.values()), len(c1), []
    for held, s in zip(out, seqs, strict=True):
        base = score = 0.0
        for i in range(1, len(s)):
            w, a = s[i], s[i - 1]
            p = (c1[w] + 1) / (n + v + 1)
            base += math.log10(p)
            if c1[a]:
                p *= discount * t1[a] / c1[a]
                if c2[a, w]:
                    p += code((c2[a, w] - discount) / c1[a])
            if i > 1 and c2[s[i - 2], a]:
                h = (s[i - 2], a)
                p *= code(discount * t2[h] / c2[h])
                if c3[(*h, w)]:
                    p += code((c3[(*h, w)] - discount) / c2[h])
            score += math.log10(min(p, 1.0))
        got.append((held, len(s) - 1, sum(c1[w] > 0 for w in s[1:]), n, base, score))
    return got


def compare(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert tuple(g[1:5]) == w[:4]
        assert g[5] == pytest.approx(w[4], rel=1e-9)
        assert g[6] == pytest.approx(w[5], rel=1e-6, abs=1e-6)


def test_query_against_dictionaries(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = QUERIES["op10_trie_scores"](spark, sf).orderBy("doc_id").collect()
    compare(got, plain(rows))
    scored = [(g.score, g.base_score, g.n_tokens) for g in got if g.held_out]
    assert scored and sum(s[0] for s in scored) > sum(s[1] for s in scored)  # better than words alone on held-out rows


ROWS = [
    (1, None), (2, ""), (3, "A a A a a b"), (4, "the the the the the cat the dog the owl the end the"), (5, " x\ty\n"), (6, "É é"), (None, "null id"),
    (7, "new words here the"), (7, "new words here the"), (8, "the cat the dog"), (9, "w " * 4000), (10, "never seen unknown the words"), (21, "q the r the s"),
]


@pytest.mark.parametrize("shard_tokens", [3, 40, 10**6])
def test_edge_cases_and_split_words(spark, shard_tokens):
    """Tiny shards spread the contexts of one word over many files."""
    docs = spark.createDataFrame([(*r, i, 2) for i, r in enumerate(ROWS)], "doc_id long, text string, score int, n_tokens int").repartition(3)
    got = trie.score(docs, trie.held_out(F.col("doc_id")), shard_tokens).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in (r[0], r[2]))
    want = sorted([(d, *p) for (d, _), p in zip(ROWS, plain(ROWS), strict=True)], key=key)
    compare(sorted(got, key=key), [w[1:] for w in want])


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = trie.score(docs, F.lit(True)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert trie.score(docs.limit(0), trie.held_out(F.col("doc_id"))).count() == 0


def test_rare_words_after_a_very_frequent_one(tmp_path):
    """A context of 3e8 occurrences, against probabilities that are not rounded: a word once after it, a pair once, a back-off weight."""
    texts = pa.array([b"the rare", b"the of rare", b"the of often"])
    names = [b"the", b"of", b"rare", b"often"]
    hashes = np.append(trie._hashes(names), trie._END)
    order = np.argsort(hashes)
    count = dict(zip([*names, None], [300_000_000, 200_000_000, 1_000, 5_000, 1_000_000], strict=True))
    n = np.array([count[w] for w in [*names, None]])[order]
    eliasfano.save(f"{tmp_path}/words-000000", {"h": hashes[order], "n": n, "upto": np.cumsum(n) - n}, {})
    ids = {w: int(np.nonzero(order == i)[0][0]) for i, w in enumerate([*names, None])}
    the, of, rare, often = names
    c2 = {(the, rare): 1, (the, of): 150_000_000, (of, rare): 1, (of, often): 1, (rare, None): 2, (often, None): 1}
    c3 = {(the, of, rare): 1, (the, rare, None): 1, (of, rare, None): 1, (of, often, None): 1}
    pairs = sorted(c2, key=lambda p: [ids[w] for w in p])
    triples = sorted(c3, key=lambda t: [ids[w] for w in t])
    column = lambda values: np.array(values, np.uint32)
    blob = trie._pack([
        trie._gaps(column([ids[a] for a, _ in pairs])), column([ids[b] for _, b in pairs]), column([c2[p] for p in pairs]),
        trie._gaps(column([pairs.index(t[:2]) for t in triples])), column([ids[t[2]] for t in triples]), column([c3[t] for t in triples]),
    ])
    lines = [[0, int(hashes[order][0]), len(n), int(n.sum())]]
    edges = trie._build((pa.scalar(0),), pa.table({"blob": pa.array([blob], pa.binary())}), str(tmp_path), lines, trie.DISCOUNT)
    wide = dict(zip(edges["word"].to_pylist(), edges["after"].to_pylist(), strict=True))
    got = trie.Scorer(trie.Model(str(tmp_path), lines, 1 << 40, wide, trie.DISCOUNT)).score(texts)[3]

    t1, t2, d = Counter(a for a, _ in c2), Counter(t[:2] for t in c3), trie.DISCOUNT
    for g, words in zip(got, ([the, rare], [the, of, rare], [the, of, often]), strict=True):
        want, seq = 0.0, [None, *words, None]
        for i in range(1, len(seq)):
            a, w = seq[i - 1 : i + 1]
            p = (count[w] + 1) / (int(n.sum()) + len(n) + 1)
            if t1[a]:
                p = max(c2.get((a, w), 0) - d, 0) / count[a] + d * t1[a] / count[a] * p
            if i > 1 and (seq[i - 2], a) in c2:
                h = (seq[i - 2], a)
                p = max(c3.get((*h, w), 0) - d, 0) / c2[h] + d * t2[h] / c2[h] * p
            want += math.log10(p)
        assert g == pytest.approx(want, abs=trie.STEP * (len(seq) - 1))
