"""Operator 6: language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied per language:

* text: a naive Bayes model over hashed letter trigrams of the UTF-8 bytes. It is fitted on a sample of about
  ``SAMPLE_ROWS`` different labelled texts per language (a documented bound; chosen by hash), all of them where there are
  fewer, so that every labelled language is known and copies count once. A share ``FLOOR`` of each language's mass is
  spread over all buckets, so an unseen trigram costs the same in every language. Neighbouring trigrams are no independent
  witnesses, so a long text counts as ``EFFECTIVE`` of them at its average;
* the declared language of the markup and the address suffix: how often each value goes with texts that speak a
  language, add-one smoothed, from grouped counts over all rows;
* the host: its share of languages, smoothed by that of its parent domain, which is smoothed by that of the whole table,
  from grouped counts over all rows.

Counts of a host that holds a third of all rows combine before their shuffle; the tables of evidence have one row per
host, declared value or suffix and are broadcast only when the optimizer finds them small.

Beside the languages stands an unknown one, of prior ``UNKNOWN``, whose trigrams are all equally likely; where the model
explains its own labelled rows worse than that (each scored without its own counts; ``CALIBRATE`` of them may be worse),
their likelihood takes its place. What it wins gives no evidence about hosts, declarations and suffixes.

A row is rejected when it has no letters, when the unknown language wins or when its best language stays below ``MIN_POSTERIOR``.

Nulls and edge cases: a null or letterless text gives no text evidence and is rejected, whatever else is declared; missing
declarations, suffixes and hosts give no evidence of their kind (a null host shares one prior); ties go to the
first language by code; without labelled rows nothing is known and every row is rejected; an empty table gives an
empty table; repeated rows get equal results; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.text import row_key, sheltered
from quoteloom.session import durable

SAMPLE_ROWS = 20_000
BUCKETS = 1 << 14
EFFECTIVE = 60.0
PRIOR = 20.0
MIN_POSTERIOR = 0.5
FLOOR = 0.2
UNKNOWN = 0.01
CALIBRATE = 0.01
_SLICE = 1 << 20

_FOLD = np.full(256, 32, np.uint8)  # everything but letters becomes a blank
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # log likelihood of each bucket, one row per language
    unknown: float = -math.log(BUCKETS)  # log likelihood of a letter in no language


def _buckets(data: bytes) -> np.ndarray:
    """Bucket of the trigram around each letter."""
    b = _FOLD[np.frombuffer(b" " + data + b" ", np.uint8)].astype(np.uint32)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(32 - int(math.log2(BUCKETS))))[b[1:-1] != 32]


def _blocks(data: bytes) -> Iterator[np.ndarray]:
    for at in range(0, len(data), _SLICE):  # very long texts; a border changes two trigrams of a million
        yield _buckets(data[at : at + _SLICE])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for some in _blocks(text or b""):
                counts += np.bincount(some, minlength=BUCKETS)
        for lang, counts in sums.items():
            used = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(counts[used])], ["lang", "bucket", "n"])


def _choose(batches: Iterator[pa.RecordBatch], bounds: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Texts whose hash is below the bound of their language, each once per task."""
    seen: set[tuple] = set()  # a language's sample at most
    for batch in batches:
        langs, firsts, seconds, places = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
        keep = []
        for i, key in enumerate(zip(langs, firsts, seconds, strict=True)):
            if places[i] < bounds[key[0]] and key not in seen:
                seen.add(key)
                keep.append(i)
        if keep:
            yield batch.select([0, 1, 2, 3]).take(pa.array(keep))


def _log_table(counts: np.ndarray) -> np.ndarray:
    return np.log((1 - FLOOR) * counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1) + FLOOR / BUCKETS)


def _without_own(batches: Iterator[pa.RecordBatch], languages: list[str], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Log likelihood per letter of each labelled text in its language without the text's own counts."""
    for batch in batches:
        out = []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.zeros(BUCKETS, np.int64)
            for some in _blocks(text or b""):
                own += np.bincount(some, minlength=BUCKETS)
            if own.any():
                out.append(float((own * _log_table(counts[languages.index(lang)] - own)).sum() / own.sum()))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["average"])


def fit(labelled: DataFrame, label: str = "lang", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """The text model of about ``sample_rows`` texts per language; its table is languages x ``BUCKETS``, whatever the input's size."""
    rows = labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    keyed = rows.select(F.col(label).cast("string").alias("lang"), F.col(text).cast("binary").alias("text"), *row_key(label, text))
    totals = keyed.groupBy("lang").agg(F.approx_count_distinct("_k1", 0.02).alias("n")).collect()  # a row per language
    bounds = {r.lang: min(1 << 32, (sample_rows << 32) // max(r.n, 1)) for r in totals}
    mine = keyed.withColumn("_at", F.shiftrightunsigned("_k1", 32)).mapInArrow(lambda it: _choose(it, bounds), "lang string, text binary, _k1 long, _k2 long")
    sample = durable(mine.dropDuplicates(["lang", "_k1", "_k2"]).select("lang", "text"))
    found = sample.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in found})
    place, counts = {x: i for i, x in enumerate(languages)}, np.zeros((len(languages), BUCKETS), np.int64)
    for r in found:
        counts[place[r.lang], r.bucket] = r.n
    scored = sample.filter(F.col("lang").isin(languages)).mapInArrow(lambda it: _without_own(it, languages, counts), "average double")
    worst = scored.agg(F.percentile_approx("average", CALIBRATE, 10_000)).first()[0] if languages else None
    unknown = min(-math.log(BUCKETS), worst) if worst is not None else -math.log(BUCKETS)
    return TextModel(languages, _log_table(counts).astype(np.float32), unknown)


def text_evidence(text: Column, model: TextModel) -> Column:
    """Array: number of letters, then the log likelihood of the text in each language."""
    table = model.table

    @F.pandas_udf("array<double>")
    def udf(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            got = np.zeros(1 + len(table))
            for some in _blocks(t or b""):
                got[0] += len(some)
                got[1:] += table[:, some].sum(axis=1, dtype=np.float64)
            out.append(got)
        return pd.Series(out)

    return udf(text.cast("binary"))


def _shares(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows per value of ``key`` and language of the text, as an array ``n``."""
    counts = [F.sum((F.col("_said") == i).cast("long")).alias(f"_n{i}") for i in range(size)]
    return rows.groupBy(key).agg(*counts).select(key, F.array(*[f"_n{i}" for i in range(size)]).alias("n"))


def _smoothed(n: Column, prior, size: int, weight: float) -> Column:
    whole = F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.array(*[(F.get(n, F.lit(i)) + weight * prior(i)) / (whole + weight) for i in range(size)])


def parent_of(host: Column) -> Column:
    """The last two labels of a host; the host itself if it has no more."""
    return F.substring_index(host, ".", -2)


def evidence_tables(rows: DataFrame, size: int, prior: float = PRIOR) -> dict[str, DataFrame]:
    """``declared``, ``suffix``: (value, likelihoods); ``host``: (host, prior). From rows with ``_said``, the text's language."""
    votes = rows.filter("_said IS NOT NULL")
    hosts = durable(_shares(votes, "_host", size))
    whole = hosts.agg(*[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(size)]).first()
    total = sum(v or 0 for v in whole)
    overall = [((v or 0) + 1.0) / (total + size) for v in whole]
    parents = hosts.groupBy(parent_of(F.col("_host")).alias("_parent")).agg(F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(size)]).alias("pn"))
    smooth = parents.select("_parent", _smoothed(F.col("pn"), lambda i: overall[i], size, prior).alias("up"))
    joined = hosts.withColumn("_parent", parent_of(F.col("_host"))).join(smooth, "_parent")
    out = {"host": durable(joined.select("_host", _smoothed(F.col("n"), lambda i: F.get("up", F.lit(i)), size, prior).alias("_prior")))}
    for name in ("declared", "suffix"):
        seen = durable(_shares(votes.filter(f"_{name} IS NOT NULL"), f"_{name}", size))
        sums = seen.agg(F.count(F.lit(1)).alias("k"), *[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(size)]).first()
        given = F.array(*[(F.get("n", F.lit(i)) + 1.0) / float((sums[f"n{i}"] or 0) + sums["k"] + 1) for i in range(size)])
        out[name] = seen.select(f"_{name}", given.alias(f"_given_{name}"))
    out["overall"] = overall
    return out


def identify(
    rows: DataFrame, model: TextModel, keep: Sequence[str], text: Column, declared: Column | None = None, suffix: Column | None = None, host: Column | None = None,
    min_posterior: float = MIN_POSTERIOR,
) -> DataFrame:
    """``keep`` plus ``predicted`` (null: unknown), ``posterior``, ``accepted`` per row."""
    size, nothing = len(model.languages), F.lit(None).cast("string")
    if not size:
        return rows.select(*keep, nothing.alias("predicted"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    said = F.lower(declared) if declared is not None else nothing
    narrow = rows.select(
        *keep,
        text_evidence(text, model).alias("_text"),
        F.nullif(F.regexp_extract(said, "^[a-z]+", 0), F.lit("")).alias("_declared"),
        (F.nullif(F.lower(suffix), F.lit("")) if suffix is not None else nothing).alias("_suffix"),
        F.coalesce(host if host is not None else nothing, F.lit("")).alias("_host"),
    )
    narrow = durable(narrow)
    letters = F.get("_text", F.lit(0))
    loud = F.slice("_text", 2, size)
    scale = F.when(letters > 0, F.least(F.lit(1.0), F.lit(EFFECTIVE) / letters)).otherwise(0.0)
    # share of the best language by the text alone against the unknown one
    doubt = (letters * model.unknown - F.array_max(loud)) * scale + math.log(UNKNOWN / (1 - UNKNOWN))
    narrow = narrow.withColumn("_known", 1.0 / (1.0 + F.exp(doubt)))
    narrow = narrow.withColumn("_said", F.when((letters > 0) & (F.col("_known") >= 0.5), F.array_position(loud, F.array_max(loud)) - 1))
    tables = evidence_tables(narrow, size)
    fused = narrow.join(tables["host"], "_host", "left").join(tables["declared"], "_declared", "left").join(tables["suffix"], "_suffix", "left")

    def log_of(column: str, i: int, other: float) -> Column:
        return F.ln(F.coalesce(F.get(column, F.lit(i)), F.lit(other)))

    weights = [
        F.get("_text", F.lit(i + 1)) * scale + log_of("_prior", i, tables["overall"][i]) + log_of("_given_declared", i, 1.0) + log_of("_given_suffix", i, 1.0)
        for i in range(size)
    ]
    fused = fused.withColumn("_w", F.array(*weights)).withColumn("_top", F.array_max("_w"))
    mass = F.aggregate("_w", F.lit(0.0), lambda a, w: a + F.exp(w - F.col("_top")))
    best = F.get(F.array(*[F.lit(x) for x in model.languages]), (F.array_position("_w", F.col("_top")) - 1).cast("int"))
    found = fused.withColumns({"_best": best, "_mass": F.col("_known") / mass})
    ok = (letters > 0) & (F.col("_known") >= 0.5) & (F.col("_mass") >= min_posterior)
    return found.select(*keep, F.when(ok, F.col("_best")).alias("predicted"), F.col("_mass").alias("posterior"), ok.alias("accepted"))


def of_documents(docs: DataFrame, keep: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """Documents: the label is the declared language, the source stands for the host, its ending for the suffix."""
    model = fit(docs)
    source = F.lower(F.col("source"))
    suffix = F.when(F.contains(source, F.lit(".")), F.substring_index(source, ".", -1))
    return identify(docs, model, keep, F.col("text"), F.col("lang"), suffix, source)


_HIDDEN = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def of_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Web pages: ``page_id, predicted, posterior, accepted`` by their text, markup, address and host."""
    from quoteloom.llm.urls import parse

    host, _ = parse(F.col("url"))
    declared = F.regexp_extract(F.col("html"), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    visible = F.regexp_replace(F.col("html"), _HIDDEN, " ")
    return identify(pages, fit(labelled), ["page_id"], visible, declared, F.substring_index(host, ".", -1), host)


@sheltered("doc_id", "text", "lang", "source")
def keep_accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is known, with all their columns, whatever their names.

    Null, empty and letterless texts go; rows equal in id, text, language and source stay or go together; an empty table stays empty.
    """
    keyed = docs.select("*", *row_key("doc_id", "text", "lang", "source"))
    bad = of_documents(keyed, ("_k1", "_k2")).filter(~F.col("accepted")).select("_k1", "_k2").distinct()
    return keyed.join(durable(bad), ["_k1", "_k2"], "left_anti").drop("_k1", "_k2")
