"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

A stage's intermediate tables are needed until its result is written; the next stage removes them as it starts.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quoteloom.llm import langid, mixing, records, simhash, winnow
from quoteloom.llm.text import table
from quoteloom.session import checkpoint_dir, recorded, release

_LEFT: list[str] = []


def _stage(fn):
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _LEFT)
        with recorded() as made:
            out = fn(spark, docs, sf_dir)
        _LEFT[:] = made
        return out

    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay.

    Null, empty and letterless texts go; repeated rows stay or go together; an empty table stays empty.
    """
    return langid.keep_accepted(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id (null last).

    Null, empty and wordless texts form one group; of rows equal in id and text one stays; an empty table stays empty.
    """
    return simhash.keep_one(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and wordless texts hold none and stay; without items every row stays; repeated rows stay or go together.
    """
    return winnow.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; documents come in training order, once per pass that takes them.

    Null and wordless texts have no words to take and go; a null source is a source of its own; repeated rows are documents of their own.
    """
    return mixing.mix(docs)


@_stage
def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary records; returns what the files hold: doc_id, start, n_tokens, ids_crc32.

    A null text is an empty one and holds its end id; rows stand by doc_id (null first), repeated rows side by side; an empty table gives none.
    """
    return records.round_trip(spark, docs, records.default_tokenizer())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_records", token_records),
]

# Text models, hash masks and tokenizers are out of SQL's reach; tests/llm/test_pipeline.py holds each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            release(spark, [before])
        docs, before = spark.read.parquet(path), path
    return docs
