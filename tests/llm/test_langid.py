"""Language identification of texts that no fitted language explains."""

import random

import pytest
from pyspark.sql import functions as F

from quoteloom.llm import langid

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def foreign():
    rng = random.Random(5)
    scripts = ["我们的人民在这里生活和工作，天气很好。", "Русский текст о погоде и о природе.", "Ελληνικό κείμενο για τον καιρό.", "هذا نص عربي عن الطقس", "xqzj kvvw"]
    return scripts + [" ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(3, 9))) for _ in range(60)) for _ in range(20)]


def test_what_no_language_explains_is_rejected(spark, sf):
    """Also where declaration, suffix and host all speak for a language; the labelled documents all stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(-1 - i, t, "es", "site.es") for i, t in enumerate(foreign())], docs.schema)
    for declared, source in ((None, None), (F.col("lang"), F.col("source"))):
        got = langid.identify(docs.union(odd), model, ["doc_id"], F.col("text"), declared, None, source).collect()
        assert {r.accepted for r in got if r.doc_id < 0} == {False}
        assert {r.predicted for r in got if r.doc_id < 0} == {None}
        assert all(r.accepted for r in got if r.doc_id >= 0)


def test_unexplained_texts_say_nothing_about_their_host(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(t, "h") for t in foreign()], "text string, host string")
    plain = odd.select(langid.text_evidence(F.col("text"), model).alias("t"), "host").collect()
    assert all(max(r.t[1:]) < r.t[0] * model.unknown for r in plain)
    rest = docs.select("text", F.lit("other").alias("host"))
    got = langid.identify(rest.union(odd).union(spark.createDataFrame([("de", "h")], odd.schema)), model, ["text", "host"], F.col("text"), host=F.col("host"))
    few = langid.identify(rest.union(spark.createDataFrame([("de", "h")], odd.schema)), model, ["text", "host"], F.col("text"), host=F.col("host"))
    one = lambda t: t.filter("host = 'h' AND text = 'de'").first().posterior
    assert one(got) == pytest.approx(one(few))


def test_every_labelled_language_is_fitted_and_copies_count_once(spark):
    """A language of five texts among 3,000, and a text that makes up a third of all rows."""
    rng = random.Random(7)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(20))
    hot = "zzzz " * 50
    rows = [("aa", text("abcdefg")) for _ in range(2000)] + [("bb", text("hijklmn")) for _ in range(5)] + [("aa", hot)] * 1000
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    model = langid.fit(docs, sample_rows=100)
    assert model.languages == ["aa", "bb"]
    whole = langid.fit(docs, sample_rows=10**6)
    once = langid.fit(docs.distinct(), sample_rows=10**6)
    assert (whole.table == once.table).all() and whole.unknown == pytest.approx(once.unknown)
    rare = spark.createDataFrame([(text("hijklmn"),) for _ in range(50)], "text string")
    assert {r.predicted for r in langid.identify(rare, model, [], F.col("text")).collect()} == {"bb"}
