"""Tables behind a commit log: a batch is seen whole or not at all, and appends open only files that can hold a key.

A batch writes three folders under a new name: its data files in key order, one line per file (rows, least and greatest key), and the files'
Bloom filters as rows of 64-bit words. It exists once its line in the log does: a small file named by the next version, created only if no one
else created it. Whatever breaks before leaves folders that no reader looks at; a repeated run starts anew. A log line may carry a
note, so a completion manifest commits together with its data, and may replace partitions of earlier batches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.session import durable

WORD_KEYS = 8  # keys of a file per 64-bit word of its filter: about 3 % false hits
PROBES = 50_000_000  # pairs of batch keys and candidate files up to which filters are asked


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _where(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    # -- log -------------------------------------------------------------------------------------
    def log(self) -> list[dict]:
        """The committed batches in order; a line that its writer did not finish does not count."""
        folder = self._where("_log")
        if not self._fs.exists(folder):
            return []
        texts = self.spark.read.text(folder.toString(), wholetext=True, pathGlobFilter="*.json").select("value", F.input_file_name().alias("name")).collect()
        lines = []
        for r in texts:
            try:
                lines.append({**json.loads(r.value), "version": int(r.name.rsplit("/", 1)[-1].removesuffix(".json"))})
            except ValueError:
                continue
        return sorted(lines, key=lambda x: x["version"])

    def _next(self) -> int:
        folder = self._where("_log")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=-1) + 1

    def commit(self, version: int, line: dict) -> bool:
        """Put a line into the log as ``version``; false if another writer was first."""
        try:
            out = self._fs.create(self._where("_log", f"{version:020d}.json"), False)
        except Exception as e:  # noqa: BLE001 - the JVM says "already exists" in several classes
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps(line).encode()))
        out.close()
        return True

    # -- reading ---------------------------------------------------------------------------------
    def _live(self, log: list[dict], parts: Sequence[str] | None = None) -> DataFrame | None:
        """Lines of the files that count: those whose partition no later batch replaced."""
        tables = []
        for i, line in enumerate(log):
            if not line.get("batch"):
                continue
            gone = sorted({p for later in log[i + 1 :] for p in later.get("replaces", [])})  # partitions: days and frames
            table = self.spark.read.parquet(f"{self.path}/_files/{line['batch']}")
            table = table.filter(~F.col("part").isin(gone)) if gone else table
            tables.append(table.filter(F.col("part").isin(list(parts))) if parts is not None else table)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables) if tables else None

    def files(self, log: list[dict] | None = None, parts: Sequence[str] | None = None) -> list[str]:
        live = self._live(self.log() if log is None else log, parts)
        return [r.file for r in live.select("file").collect()] if live is not None else []  # a name per file

    def read(self, parts: Sequence[str] | None = None) -> DataFrame | None:
        """The table as of now, or nothing; a batch that commits later is not seen."""
        log = self.log()
        found = self.files(log, parts)
        schema = next((line["schema"] for line in reversed(log) if line.get("schema")), None)
        if schema is None:
            return None
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    # -- writing ---------------------------------------------------------------------------------
    def stage(self, rows: DataFrame, keys: Sequence[str], partitions: Sequence[str] = ()) -> dict:
        """Write a batch and its index without committing it; returns the line to commit."""
        schema = rows._jdf.schema().toDDL()
        if rows.isEmpty():
            return {"batch": None, "rows": 0, "schema": schema}
        batch = uuid.uuid4().hex
        data = f"{self.path}/data/{batch}"
        kept = rows.withColumns({f"_part_{p}": F.col(p).cast("string") for p in partitions})
        order = [*[f"_part_{p}" for p in partitions], *keys]
        writer = kept.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd")
        (writer.partitionBy(*[f"_part_{p}" for p in partitions]) if partitions else writer).parquet(data)
        return self._indexed(batch, self.spark.read.schema(rows.schema).parquet(data), keys, schema)

    def adopt(self, keys: Sequence[str]) -> None:
        """Commit the plain Parquet files of a folder that has no log yet, where they lie."""
        if not self._fs.exists(self._where()) or not any(s.getPath().getName().endswith(".parquet") for s in self._fs.listStatus(self._where())):
            return
        plain = self.spark.read.parquet(self.path)
        self.commit(0, self._indexed(uuid.uuid4().hex, plain, keys, plain._jdf.schema().toDDL()))

    def _indexed(self, batch: str, data: DataFrame, keys: Sequence[str], schema: str) -> dict:
        read = data.select(*keys, F.input_file_name().alias("file"))
        ranges = [f(k).alias(f"{n}_{k}") for k in keys for n, f in (("low", F.min), ("high", F.max))]
        part = F.array_join(F.filter(F.split(F.col("file"), "/"), lambda x: x.startswith("_part_")), "/")
        words = F.ceil(F.col("rows") / WORD_KEYS).cast("long").alias("words")
        lines = read.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *ranges).withColumn("part", part).select("*", words)
        lines.coalesce(1).write.parquet(f"{self.path}/_files/{batch}")
        sizes = self.spark.read.parquet(f"{self.path}/_files/{batch}")
        hashed = read.join(sizes.select("file", "words"), "file").select("file", _word(keys, F.col("words")).alias("word"), _bits(keys).alias("bits"))
        hashed.groupBy("file", "word").agg(F.bit_or("bits").alias("bits")).write.parquet(f"{self.path}/_bloom/{batch}")
        count = sizes.agg(F.sum("rows")).first()[0] or 0
        return {"batch": batch, "rows": count, "schema": schema}

    def candidates(self, log: list[dict], batch_keys: DataFrame, keys: Sequence[str]) -> list[str]:
        """Files that can hold one of the keys: by their ranges, then by their Bloom filters."""
        live = self._live(log)
        if live is None:
            return []
        ends = [f(k).alias(f"{n}_{k}") for k in keys for n, f in (("low", F.min), ("high", F.max))]
        span = batch_keys.agg(F.count(F.lit(1)).alias("n"), *ends).first()  # one row
        if not span.n or any(span[f"low_{k}"] is None for k in keys):
            return []  # a key with a null equals none
        near = reduce(lambda a, b: a & b, [(F.col(f"high_{k}") >= span[f"low_{k}"]) & (F.col(f"low_{k}") <= span[f"high_{k}"]) for k in keys])
        near_files = [r.file for r in live.filter(near).select("file").collect()]  # a name per file
        if not near_files or span.n * len(near_files) > PROBES:
            return near_files
        blooms = [f"{self.path}/_bloom/{line['batch']}" for line in log if line.get("batch")]
        chosen = live.filter(F.col("file").isin(near_files)).select("file", "words")
        sizes = [r.words for r in chosen.select("words").distinct().collect()]  # a number per file at most
        asked = batch_keys.withColumn("words", F.explode(F.array(*[F.lit(n).cast("long") for n in sizes])))
        probes = asked.select("words", _word(keys, F.col("words")).alias("word"), _bits(keys).alias("want"))
        stored = self.spark.read.parquet(*blooms).join(F.broadcast(chosen), "file")  # a row per file near the batch
        hit = stored.join(probes, ["words", "word"]).filter(F.col("bits").bitwiseAND(F.col("want")) == F.col("want"))
        return sorted(r.file for r in hit.select("file").distinct().collect())


def _word(keys: Sequence[str], words: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), words)


def _bits(keys: Sequence[str]) -> Column:
    h = F.xxhash64(F.lit(1), *keys)
    out = F.lit(0).cast("long")
    for i in range(4):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out


def append_new(df: DataFrame, path: str, keys: Sequence[str], note: dict | None = None, before_commit: Callable[[], None] | None = None) -> dict:
    """Append the rows whose keys the store does not hold; ``df`` has each key once. Says what was ``written`` and how many files were ``opened``.

    When another writer commits first, only what it committed is looked at again. ``before_commit`` is called between data and log (for tests).
    """
    spark, keys = df.sparkSession, list(keys)
    store, rows = Store(spark, path), durable(df)
    opened, known = 0, 0
    if not store.log():
        store.adopt(keys)
    while True:
        version, log = store._next(), store.log()
        files = store.candidates(log[known:], rows.select(*keys), keys)
        if files:
            held = spark.read.parquet(*files).select(*keys)
            rows = durable(rows.join(held, keys, "left_anti"))
        opened, known = opened + len(files), len(log)
        line = store.stage(rows, keys)
        if before_commit:
            before_commit()
        if store.commit(version, {**line, "note": note or {}}):
            return {"written": line["rows"], "opened": opened}


def replace_parts(df: DataFrame, path: str, keys: Sequence[str], partitions: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
    """Write whole partitions in place of the stored ones; ``merge(stored, new)`` makes the new content from the touched partitions.

    A merge that another writer overtakes is made again on what is stored then.
    """
    spark = df.sparkSession
    store, new = Store(spark, path), durable(df)
    names = new.select(F.concat_ws("/", *[F.concat(F.lit(f"_part_{p}="), F.col(p).cast("string")) for p in partitions]).alias("part")).distinct()
    parts = sorted(r.part for r in names.collect())  # days and frames
    while True:
        version = store._next()
        stored = store.read(parts) if merge else None
        line = store.stage(new if stored is None else merge(stored, new), keys, partitions)
        if store.commit(version, {**line, "replaces": parts}):
            return
