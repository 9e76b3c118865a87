"""Session settings shared by tests, the bench and applications."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Create a session; on a cluster leave both arguments out and let spark-submit decide."""
    builder = SparkSession.builder.appName("quoteloom")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("QUOTELOOM_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """All calendar logic is UTC; the setting is per session and may change at run time."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_SCRATCH: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for cut lineage that driver and executors share.

    The setting ``spark.checkpoint.dir`` comes first, then a folder given to ``setCheckpointDir``. Only a session
    in local mode, as in tests, may go without: it gets one scratch folder, removed when Python ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _SCRATCH[app], ignore_errors=True)
    return _SCRATCH[app]


def shared_path(spark: SparkSession, kind: str = "quoteloom") -> str:
    """A new path in the shared folder."""
    path = f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def durable(df):
    """Write ``df`` once as Parquet in the shared folder and continue from the files.

    Used where a plan refers to one intermediate table several times: the table is computed once, later
    steps prune its columns, and a lost executor costs only its own tasks. ``release`` removes the files.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded():
    """Collects what is written to the shared folder inside the block, for ``release``."""
    paths: list[str] = []
    start = len(_WRITTEN)
    yield paths
    paths.extend(path for _, path in _WRITTEN[start:])


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove ``paths``, or all that this session wrote to the shared folder; call it when no result that reads them is needed."""
    gone = set(paths) if paths is not None else {path for owner, path in _WRITTEN if owner is spark}
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN[:] = [(owner, path) for owner, path in _WRITTEN if path not in gone]
