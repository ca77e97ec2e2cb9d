"""Tables and states that jobs leave in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; below a local folder only where Spark runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="spark-"))
        base = f"file://{_LOCAL[0]}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows, written and read again: what follows doesn't compute them anew."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From here on Spark hands Python batches of about so many bytes, unless the session says
    otherwise: by default a batch is a number of rows, however long they are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(most))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {n: spark.conf.get(n, None) for n in values}
    try:
        for n, value in values.items():
            spark.conf.set(n, value)
        yield
    finally:
        for n, value in before.items():
            if value is None:
                spark.conf.unset(n)
            else:
                spark.conf.set(n, value)


def shuffled(spark: SparkSession):
    """Tables written within it are joined by shuffles only. Spark takes a Parquet file's size for that of its
    rows, which can be ten times larger or more, and the driver gathers each table that it broadcasts."""
    return _settings(spark, dict.fromkeys(("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"), "-1"))


def dealt_once(spark: SparkSession):
    """Tables written within it are joined where their rows are, if those are dealt out by some of the join's
    keys, a medium say: else Spark deals them out again by all keys."""
    return _settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"})
