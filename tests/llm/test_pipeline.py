"""The pipeline as a whole, and each stage on its own input against brute force."""

import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from tests.llm.test_records import expected
from tests.llm.test_simhash import plain_components, plain_fingerprint


def split_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def contaminated(text, items):
    words = split_words(text)
    for item in items:
        w = split_words(item)
        m = min(len(w), 10)
        if m and {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} & {tuple(words[i : i + m]) for i in range(len(words) - m + 1)}:
            return True
    return False


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, columns = [docs.collect()], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        out.append(docs.collect())
    return out


def test_language_keeps_documents_with_words(stages):
    before, after = stages[0], stages[1]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if re.search(r"[^\W\d_]", r.text or "")}


def test_one_of_each_group_stays(stages):
    before, after = stages[1], stages[2]
    ids = [r.doc_id for r in before]
    roots = plain_components(ids, [plain_fingerprint(r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(set(roots))
    assert len(after) < len(before)


def test_contaminated_documents_go(spark, sf, stages):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = stages[2], stages[3]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not contaminated(r.text, items)}
    assert 0 < len(after) < len(before)


def test_sources_meet_their_targets(stages):
    before, after = stages[3], stages[4]
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before}
    source = {r.doc_id: r.source for r in before}
    total, taken = Counter(), Counter()
    for d, n in size.items():
        total[source[d]] += n
    for r in after:
        taken[r.source] += size[r.doc_id]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total))}
    full: set = set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        level = left / sum(w for s, w in weights.items() if s not in full)
        more = {s for s in total if s not in full and weights[s] * level > 2 * total[s]}
        if not more:
            break
        full |= more
    for s in total:
        want = 2 * total[s] if s in full else weights[s] * level
        assert abs(taken[s] - want) <= max(n for d, n in size.items() if source[d] == s)
    assert max(Counter(r.doc_id for r in after).values()) <= 2


def test_records_hold_all_that_came(stages):
    before, after = stages[4], stages[5]
    rows = sorted([(r.doc_id, r.text) for r in before], key=lambda r: r[0])
    assert sorted(map(tuple, after), key=lambda r: r[1]) == expected(rows)


def test_run_is_registered(spark, sf, stages):
    import __spark_entry__

    run = __spark_entry__.queries()["pipeline"]
    key = lambda r: r.start
    assert sorted(run(spark, sf).collect(), key=key) == sorted(stages[-1], key=key)
    assert corpus_pipeline.ORACLE_SQL is None
    assert math.isfinite(zlib.crc32(b"")) and np is not None


ROWS = [
    (1, None, "en", "a", 1), (2, "", None, None, None), (3, "the the the and of", "en", "a", 2), (3, "the the the and of", "en", "a", 2), (None, "und der die das ist", "de", None, 3),
    (5, "12345 !!", "en", "b", 4), (6, "word " * 30000, "en", "b", 5), (7, "le la les et de", "fr", "c.example.org", 6),
]


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Nulls, repeated rows, long texts and extra columns with clashing names; then no rows at all."""
    names = "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, root string, predicted string"
    docs = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in ROWS], names)
    spark.createDataFrame([(1, "und der die das"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, docs.limit(0)):
        now = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{'all' if rows is docs else 'none'}-{k}"
            stage(spark, now, str(tmp_path)).write.parquet(path)
            now = spark.read.parquet(path)
            if k < 4:
                assert now.columns == docs.columns
        if rows is docs:
            assert {r.doc_id for r in now.collect()} <= {3, 6, 7}
            assert now.count() >= 3
        else:
            assert now.count() == 0
