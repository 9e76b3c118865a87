"""The character model against a plain modified Kneser-Ney, the base counts and bands against their definitions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quoteloom.llm import perplexity

SPACES = r"[\x20\x09-\x0D]+"
ODD = [
    None, "", " \n\t ", "one", "Ab Ab\nAb Ab\n\nAb Ab\n", "x\x02y\x03 12 345", "é É 漢字 😀 ß", "w " * 3000, "X" * 20_000, "l1\nl2\nl1\n \nl2 \n", "a b c a b c d e",
    "# * $ % & | < > ##", "same words", "same words", "\r\na\r\na\x0b b\x0c",
]


def plain_characters(text):
    words = [w for w in re.split(SPACES, (text or "").lower()) if w]
    body = re.sub("[0-9]", "0", " ".join(words).replace("\x02", "�").replace("\x03", "�"))
    return "\x02" * 4 + body + "\x03"


class Plain:
    """One language's model, straight from the formulas."""

    def __init__(self, texts, order=5):
        self.order, self.counts = order, {}
        grams = Counter()
        for t in texts:
            c = plain_characters(t)
            grams.update(c[i : i + order] for i in range(len(c) - order + 1))
        self.counts[order] = grams
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d, self.after = {}, {}
        for k, counted in self.counts.items():
            n = Counter(counted.values())
            fallback = {1: 0.5, 2: 1.0, 3: 1.5}
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
            self.d[k] = {i: min(i, max(0.05, i - (i + 1) * y * n[i + 1] / n[i])) if n[1] and n[2] and n[i] else fallback[i] for i in (1, 2, 3)}
            after = defaultdict(list)
            for g, c in counted.items():
                after[g[:-1]].append(c)
            self.after[k] = after

    def p(self, gram):
        if not gram:
            return 1 / (len(self.counts[1]) + 1)
        k, context = len(gram), gram[:-1]
        seen = self.after[k].get(context)
        if not seen:
            return self.p(gram[1:])
        d, c = self.d[k], self.counts[k].get(gram, 0)
        g = sum(d[min(x, 3)] for x in seen) / sum(seen)
        return max(c - (d[min(c, 3)] if c else 0), 0) / sum(seen) + g * self.p(gram[1:])

    def score(self, text):
        c = plain_characters(text)
        return sum(math.log10(self.p(c[i : i + self.order])) for i in range(len(c) - self.order + 1)), len(c) - self.order + 1


def texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["the", "cat", "sat", "on", "mats", "12", "Dog"]) for _ in range(rng.randrange(0, 90))) for _ in range(n)]


def test_scores_against_plain_model(spark):
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(ODD + texts(1, 60))]
    docs = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "doc_id long, text string, lang string, n long, p int, gram string").repartition(3)
    got = {r.doc_id: r for r in perplexity.judge(docs).collect()}
    assert len(got) == len(rows) and set(docs.columns) < set(perplexity.judge(docs).columns)
    for lang in ("en", "de", None):
        mine = [(i, t) for i, t, x in rows if x == lang]
        model = Plain([t for _, t in mine])
        for i, t in mine:
            score, n = model.score(t)
            q = got[i]["_quality"]
            if n == 1:
                assert (q.log10_p, q.n_chars_scored, q.log_perplexity) == (0.0, 0, None)
            else:
                assert q.n_chars_scored == n and q.log10_p == pytest.approx(score, rel=1e-5)


def test_probabilities_add_up_and_unknown_characters_have_some(spark):
    train = [(t, "en") for t in texts(2, 40)]
    model = perplexity.train(spark.createDataFrame(train, "text string, lang string"))
    arrays, plain = perplexity.Arrays(model), Plain([t for t, _ in train])
    new = ["the zebra", "q", "sat on", "漢", *ODD[3:7]]
    log, n = perplexity.score_texts(arrays, pa.array(["en"] * len(new)), pa.array(new))
    for i, t in enumerate(new):
        assert (log[i], n[i]) == (pytest.approx(plain.score(t)[0], rel=1e-5), plain.score(t)[1])
    tables = perplexity.probabilities(spark.createDataFrame(train, "text string, lang string"))
    for k in (1, 2, 3):
        context = F.expr(f"substring(gram, 1, {k - 1})")
        starts = F.expr("gram NOT LIKE '%\x02'")
        left = tables[k].filter(starts).groupBy(context.alias("c")).agg(F.sum("p").alias("p")).collect()
        letters = set(plain.counts[1])
        for r in left:  # what the seen successors leave goes to the others
            rest = sum(plain.p(r.c + w) for w in letters if r.c + w not in plain.counts[k])
            unknown = plain.p(r.c + "\U0001f600")
            assert r.p + rest + unknown == pytest.approx(1)


def test_runs_of_equal_hashes():
    rng = np.random.default_rng(1)
    for h in (rng.integers(0, 9, 200).astype(np.uint64), rng.integers(0, 40, 300).astype(np.uint64) << np.uint64(50), np.array([5], np.uint64), np.zeros(0, np.uint64)):
        order, begin = perplexity._runs(h)
        assert sorted(order.tolist()) == list(range(len(h))) and h[order].tolist() == sorted(h.tolist())
        assert h[order][begin].tolist() == sorted(set(h.tolist()))


def plain_counts(text):
    text = text or ""
    words = [w for w in re.split(SPACES, text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.sub(SPACES, "", x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


def test_base_counts():
    rng = random.Random(3)
    some = ODD + ["".join(rng.choice("ab \n#é") for _ in range(rng.randrange(60))) for _ in range(300)]
    for array in (pa.array(some), pa.array(["junk", *some]).slice(1)):
        got = perplexity.base_counts(array)
        want = np.array([plain_counts(t) for t in some])
        for k, name in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")):
            assert got[name].tolist() == want[:, k].tolist(), name


def test_bands_keep_clean_documents_and_reject_noise_and_boilerplate(spark):
    rng = random.Random(4)
    syllables = {"en": ["tha", "ing", "er", "on", "sta", "re", "ble"], "de": ["sch", "ein", "ung", "ver", "kei", "lich"]}

    def prose(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))

    rows = [(i, prose(lang, rng.randrange(60, 300)), lang) for i, lang in enumerate(["en", "de"] * 150)]
    noise = [(1000 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz#$%&") for _ in range(6)) for _ in range(80)), "en") for i in range(6)]
    few = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(100)]
    copies = [(2000 + i, rows[0][1], "en") for i in range(40)]  # copies of one text do not narrow the band
    dull = [(4000, " ".join("tha" + x for x in few), "en")]
    docs = spark.createDataFrame(rows + noise + copies + dull, "doc_id long, text string, lang string")
    got = {r.doc_id: r["_quality"] for r in perplexity.judge(docs).collect()}
    assert sum(got[i].kept for i, _, _ in rows) >= 0.98 * len(rows)
    assert not any(got[i].kept for i, _, _ in noise)
    assert len({got[i].log_perplexity for i, _, _ in copies}) == 1
    for q in got.values():
        assert q.kept == (not q.base_failed and q.lower <= q.log_perplexity <= q.upper)
        assert q.base_failed == (q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words)


def test_empty_table_and_free_names(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 3)], "doc_id long, text string, lang string, _quality int")
    assert perplexity.judge(docs).columns == [*docs.columns, "__quality"]
    assert perplexity.judge(docs.limit(0)).collect() == []
