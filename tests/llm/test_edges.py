"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for the native operators."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_pipeline import split_words

from quoteloom.llm import langid, lines, mixing, shards, simhash, urls, winnow

CLASH = "doc_id long, text string, lang string, source string, size int, shard int, at int, n long, host string, _unused int"
TEXTS = [None, "", "one", "a b c d e f g h i j k", "X" * 50_000, "w " * 30_000, "l1\nl2\nl3\nl4", "l1\nl2\nl3", "\n\n\n\n", "same", "same"]
ROWS = [(i if i < 9 else 9, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", 7, 7, 7, 7, "x", 1) for i, t in enumerate(TEXTS)]
ROWS.append((None, "l1\nl2\nl3", "en", "s1", 7, 7, 7, 7, "x", 1))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, CLASH).repartition(3).cache()


# --- sharding ---------------------------------------------------------------------------------------------------------


def check_shards(rows, count):
    slots = {}
    for r in rows:
        assert 0 <= r.shard < count
        slots.setdefault(r.shard, []).append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return Counter({k: sum(r.size for r in rows if r.shard == k) for k in slots})


def plain_tree(points, count, first=0):
    """Shards by exact weighted medians of all rows: points are (keys per dimension, size, row)."""
    if count == 1 or not points:
        return {p[2]: first for p in points}
    width = 1 << 31
    spans = [max(p[0][d] // width for p in points) - min(p[0][d] // width for p in points) for d in range(4)]
    d = spans.index(max(spans))
    order = sorted({p[0][d] for p in points})
    weight = {k: sum(p[1] for p in points if p[0][d] == k) for k in order}
    goal, under = sum(p[1] for p in points) * (count // 2) / count, 0
    for k in order:
        if under + weight[k] >= goal:
            cut = k if goal - under <= weight[k] / 2 else k + 1
            break
        under += weight[k]
    half = count // 2
    low, high = [p for p in points if p[0][d] < cut], [p for p in points if p[0][d] >= cut]
    return plain_tree(low, half, first) | plain_tree(high, count - half, first + half)


def test_shards_against_plain_medians(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    rows = shards.shard(documents, 40).collect()
    sizes = check_shards(rows, 40)
    text = {r.doc_id: r.text for r in documents.collect()}
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    want = sum(sizes.values()) / 40
    assert max(abs(s - want) for s in sizes.values()) <= 6 * max(r.size for r in rows)  # a row per level
    keys = [((p._source, p._lang, p._length, p._id), p.size, p.doc_id) for p in shards.points(documents).collect()]
    tree = plain_tree(keys, 40)
    assert {r.doc_id: r.shard for r in rows} == tree


@pytest.mark.parametrize("count", [1, 2, 40])
def test_shards_of_odd_rows(docs, count):
    rows = shards.shard(docs, count).collect()
    assert len(rows) == len(ROWS)
    check_shards(rows, count)
    assert shards.shard(docs.limit(0), count).count() == 0
    assert shards.shards_for(docs, 1 << 40) == 1


# --- mixing -----------------------------------------------------------------------------------------------------------


def test_mixing_of_odd_rows(docs):
    rows = mixing.plan(docs).collect()
    assert len(rows) == len(ROWS)
    assert [r._taken for r in rows if r._size == 0] == [0] * sum(r._size == 0 for r in rows)
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r._taken <= 2 * r._size and r._target <= 2 * r._source_size + 1e-9
        assert (r._position is None) == (r._taken == 0)
        taken[r._source_size, r._target] += r._taken
        target[r._source_size, r._target] = r._target
    for k, t in target.items():
        assert abs(taken[k] - t) <= 0.5 + 1e-9
    assert sum(target.values()) == pytest.approx(1.5 * sum(r._size for r in rows))
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).columns == docs.columns
    again = mixing.plan(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_curriculum_inverts_demand(spark):
    tilts = [(x / 10, s) for x in range(11) for s in (-0.9, -0.5, 0.0, 0.5, 0.9)]
    rows = spark.createDataFrame(tilts, "x double, s double").select("x", "s", mixing.demand_time(F.col("x"), F.col("s")).alias("t")).collect()
    for r in rows:
        assert (1 - r.s) * r.t + r.s * r.t * r.t == pytest.approx(r.x, abs=1e-12)


def test_targets_are_water_filled(spark):
    sizes = [("a", 10), ("b", 100), ("c", 1000), (None, 5), ("d", 0), ("ä", 50)]
    got = {r.source: r._target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, _size long")).collect()}
    order, total = ["a", "b", "c", "d", "ä", None], dict(sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(weight[s] * mid, 2 * total[s]) for s in order) < 1.5 * 1165 else (lo, mid)
    for s in order:
        assert got[s] == pytest.approx(min(weight[s] * lo, 2 * total[s]), abs=1e-6)


# --- decontamination --------------------------------------------------------------------------------------------------


def plain_contamination(text, items):
    words, hit, found = split_words(text), set(), set()
    for item, t in items:
        w = split_words(t)
        m = min(len(w), 10)
        grams = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(words) - m + 1) if m else ():
            if tuple(words[i : i + m]) in grams:
                hit |= set(range(i, i + m))
                found |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(found)


def test_contamination_of_odd_rows(spark, docs):
    items = [
        (1, "A b, c d e f g h i j"), (2, None), (3, ""), (4, "l1 l2"), (None, "same"), (5, "w " * 40), (5, "one"), (10, "c d e f g h i j k l m"),
        (11, "a b c d e f g h i j"), (12, "é É"), (13, "w w w w w w w w w x"),
    ]
    bench = spark.createDataFrame([(*i, 3, "z") for i in items], "item_id long, text string, hash int, need string")
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(20, "w " * 9 + "x É é é É b" + " same" * 3), (21, "y a b c d e f g h i j k")], "doc_id long, text string"))
    got = winnow.contamination(more, bench).collect()
    want = [(r.doc_id, *plain_contamination(r.text, items)) for r in more.collect()]
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got], key=key) == sorted(want, key=key)
    assert winnow.contamination(more.limit(0), bench).count() == 0
    assert {r.n_hit for r in winnow.contamination(more, bench.limit(0)).collect()} == {0}
    assert winnow.without_contaminated(docs, bench).columns == docs.columns


@pytest.mark.parametrize("seed", range(3))
def test_contamination_of_random_texts(spark, seed):
    """Few different words: repeats, overlaps and spans of every length around the limit."""
    rng = np.random.default_rng(seed)
    words = lambda n: " ".join(rng.choice(list("abc"), n))
    items = [(i, words(rng.integers(1, 16))) for i in range(25)]
    texts = [(i, words(rng.integers(0, 60))) for i in range(40)]
    got = winnow.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {d: plain_contamination(t, items) for d, t in texts}
    assert {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in got.collect()} == want


# --- line windows -----------------------------------------------------------------------------------------------------


def plain_lines(rows):
    """By definition: a window is later if an equal one stands at an earlier (id, row, position)."""
    first, out = {}, {}
    ordered = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows if r[1] is not None})
    for known, doc, text in ordered:
        part, gone = text.split("\n"), set()
        for i in range(len(part) - 2):
            w = "\n".join(part[i : i + 3])
            if w.replace("\n", "").strip(" ") and first.setdefault(w, (known, doc, text, i)) != (known, doc, text, i):
                gone |= {i, i + 1, i + 2}
        out[doc if known else None, text] = "\n".join(x for i, x in enumerate(part) if i not in gone)
    return out


def test_line_windows_of_odd_rows(spark, docs):
    got = lines.dedup_lines(docs)
    want = plain_lines([(r[0], r[1]) for r in ROWS])
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r[0], want[r[0], r[1]] if r[1] is not None else None) for r in ROWS)
    assert set(docs.columns) <= set(got.columns)
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    rng = np.random.default_rng(3)
    rows = [(i, "\n".join(rng.choice(list("ab "), rng.integers(1, 12)))) for i in range(60)]
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in found} == {d: t for (d, _), t in plain_lines(rows).items()}


# --- addresses --------------------------------------------------------------------------------------------------------


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    host = rest[: min(ends, default=len(rest))]
    path = rest[len(host) :]
    ends = [i for i in (path.find(c) for c in "?#") if i >= 0]
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lowered, path[: min(ends, default=len(path))]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme/org/", "http://", "http://ORG", "http://org/", "https://A.Example.ORG/es/1?x#y", "http://example.org/es", "http://example.org/en/12",
    "http://x.com/fr/1", "http://x.com/de/2", "http://x.com/de/3", "http://x.com#/de/", "http://x.com?u=http://org/", "http://xcom/fr/", "ftp://É.com/fr/É/" + "a/" * 300,
    "http://net/a//b", "http://x.com/de/2",
]


def test_urls(spark, sf):
    pages = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(URLS)], "page_id long, url string, host string, template string")
    for table in (pages, spark.read.parquet(f"{sf}/pages.parquet")):
        rows = {r.page_id: r.url for r in table.collect()}
        got = urls.judge(table).collect()
        assert len(got) == len(rows)
        for r in got:
            host, path = plain_url(rows[r.page_id])
            rule, verdict = plain_rule(host, path)
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == (verdict or ("block" if r.purity > urls.REJECT_ABOVE else "allow"))
            assert len(r.template) == len([s for s in path.split("/") if s])
    assert urls.judge(pages.limit(0)).count() == 0


def test_templates_learn_from_labels(spark):
    """A host whose labelled branch is bad loses its unlabelled pages of that template, another host keeps its own."""
    bad = [f"http://bad.com/de/shop/{i}" for i in range(300)] + [f"http://bad.com/x/shop/{i}" for i in range(200)]
    good = [f"http://good.com/fr/shop/{i}" for i in range(300)] + [f"http://good.com/x/shop/{i}" for i in range(200)]
    table = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(table).collect()}
    assert {tuple(r.template) for r in got.values()} == {(a, "shop", "*") for a in ("de", "fr", "x")}
    assert {got[i].verdict for i in range(300, 500)} == {"block"}  # spoken for by their host
    assert {got[i].verdict for i in range(800, 1000)} == {"allow"}


# --- language ---------------------------------------------------------------------------------------------------------


def test_languages(spark, sf, docs):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.of_documents(documents).collect()
    assert len(got) == documents.count()
    assert sum(r.predicted == r.lang for r in got) >= 0.98 * len(got)
    odd = langid.of_documents(docs, docs.columns).collect()
    assert len(odd) == len(ROWS)
    assert all(r.accepted == any(c.isalpha() for c in r.text or "") for r in odd)
    assert langid.of_documents(docs.limit(0)).count() == 0
    assert {r.accepted for r in langid.of_documents(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {False}


def test_language_of_held_out_rows_by_text_alone(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(documents.filter("doc_id % 2 = 0"))
    rest = documents.filter("doc_id % 2 = 1")
    got = langid.identify(rest, model, ["doc_id", "lang"], F.col("text")).collect()
    assert sum(r.predicted == r.lang for r in got) >= 0.98 * len(got)


def test_evidence_beside_the_text_decides_short_texts(spark, sf):
    """The same two letters: markup, suffix and host settle what the text leaves open."""
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", F.lit(None).cast("string").alias("said"), F.lit("h").alias("host"))
    long = documents.select("text", F.col("lang").alias("said"), F.concat("lang", F.lit(".x")).alias("host"), F.lit(0).alias("k"))
    short = spark.createDataFrame([("de", lang, f"{lang}.x", 1) for lang in ("de", "fr", "es")], "text string, said string, host string, k int")
    model = langid.fit(documents)
    got = langid.identify(long.union(short), model, ["said", "k"], F.col("text"), F.col("said"), F.substring_index("host", ".", 1), F.col("host"))
    assert all(r.predicted == r.said for r in got.filter("k = 1").collect())


# --- names of the input -----------------------------------------------------------------------------------------------


INSIDE = ["_k1", "_k2", "_size", "_at", "_lines", "_p", "_passes", "n_lines", "n_removed", "at", "root", "fp", "accepted", "n_hit", "item_ids", "_pass0", "_unit", "h1"]


def test_columns_that_are_called_like_inner_ones_pass_through(spark):
    texts = ["a b c d e f g h i j k l", "l1\nl2\nl3\nl4", "l1\nl2\nl3", None, "a b c d e f g h i j k l"]
    rows = [(i, t, "en", "s", *[f"{n}{i}" for n in INSIDE]) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in INSIDE))
    bench = spark.createDataFrame([(1, "c d e f g h i j k l")], "item_id long, text string")
    outs = {
        "language": langid.keep_accepted(table), "mixing": mixing.mix(table), "near copies": simhash.keep_one(table), "contamination": winnow.without_contaminated(table, bench),
    }
    for name, out in outs.items():
        assert out.columns == table.columns, name
        got = out.collect()
        assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in INSIDE), name
    assert {r.doc_id for r in outs["contamination"].collect()} == {1, 2, 3}
    cleaned = lines.dedup_lines(table)
    assert cleaned.columns == [*table.columns, "_n_lines", "_n_removed"]
    assert {(r.doc_id, r.n_lines, r._n_removed) for r in cleaned.collect()} == {(i, f"n_lines{i}", 3 if i == 2 else 0) for i in range(5)}
