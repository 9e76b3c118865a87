"""The Merkle manifest against a plain recursion over whole groups."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quoteloom.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars int, text string, tree string, at int, size int, digest string, block int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def proofs(digests, arity):
    """(root, proof of each place) by definition, level by level."""
    out, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, where in enumerate(at):
            run = level[where // arity * arity : where // arity * arity + arity]
            out[i] += [d for j, d in enumerate(run) if j != where % arity]
            at[i] = where // arity
        level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
    return (level[0] if level else ""), out


def plain(rows, arity=2):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r[:5]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: proofs([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], arity) for g in names}
    root, above = proofs([below[g][0] for g in names], arity)
    out = []
    for i, g in enumerate(names):
        for x, proof in zip(sorted(groups[g], key=lambda x: x[:3]), below[g][1], strict=True):
            out.append((x[3][0], x[2], below[g][0], root, tuple(proof + above[i])))
    return sorted(out, key=str)


def rows_of(n):
    langs = [None, "en", "en", "en", "é", "zz", "", "en"]
    return [(i // 2 if i % 11 else None, f"s{i % 3}" if i % 4 else None, langs[i % 8], None if i % 5 == 0 else i, None if i % 7 == 0 else "ü" * (i % 9), "t", 1, 1, "d", 1) for i in range(n)]


@pytest.mark.parametrize(("n", "block", "arity"), [(1, 4, 2), (3, 4, 2), (75, 4, 2), (75, 2, 2), (300, 8, 2), (120, 9, 3), (90, 4096, 2)])
def test_manifest_against_plain_trees(spark, n, block, arity):
    rows = rows_of(n)
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = merkle.manifest(docs, block=block, arity=arity).collect()
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, tuple(r.proof)) for r in got], key=str) == plain(rows, arity)
    assert all(r.folded_root == r.root for r in got)  # every proof leads its own leaf to the root


def test_one_group_and_repeated_rows(spark):
    rows = [(7, "s", "en", 1, "same")] * 37
    got = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string"), block=4).collect()
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, tuple(r.proof)) for r in got], key=str) == plain(rows)
    assert {r.subroot == r.root for r in got} == {True}


def test_tampering_shows_in_exactly_the_tampered_rows(spark):
    rows = rows_of(150)
    docs = spark.createDataFrame(rows, COLUMNS)
    changed = {"n_chars": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1)}
    got = merkle.manifest(docs, tampered=changed, block=8).collect()
    want = {(r[0], leaf_of(r[:5])): r[0] is not None and r[0] % 3 == 0 and r[3] is not None for r in rows}
    assert all((r.folded_root != r.root) == want[r.doc_id, r.leaf] for r in got)
    assert len(got) == 150


def test_manifest_does_not_depend_on_the_order_of_rows(spark):
    rows = rows_of(60)
    one, two = (merkle.manifest(spark.createDataFrame(x, COLUMNS).repartition(k), block=4) for x, k in ((rows, 1), (rows[::-1], 5)))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_empty_table(spark):
    docs = spark.createDataFrame(rows_of(3), COLUMNS).limit(0)
    assert merkle.manifest(docs).collect() == []


def test_a_block_is_a_power_of_the_arity(spark):
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame(rows_of(3), COLUMNS), block=4096, arity=3)
