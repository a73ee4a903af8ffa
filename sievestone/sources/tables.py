"""Parquet sources and sinks: fixed schemas, versioned directories, a change log."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that operators rely on, with their types; other columns may be there.
REQUIRED = {
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a dataset; raises if a required column is missing or has another type."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    have = dict(df.dtypes)
    wrong = {c: t for c, t in REQUIRED.get(name, {}).items() if have.get(c) != t}
    if wrong:
        raise TypeError(f"{name} should have {wrong}, but has {have}")
    return df


def change_log(events: DataFrame) -> DataFrame:
    """The event table read as a log (seq, key, op, value): errors delete a user's entry, all else inserts or updates it."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), op.alias("op"), "value")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; where that isn't set, on a single machine,
    below a local temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir()
    folder = f"{base.rstrip('/')}/sievestone-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df written once and read again: what follows doesn't compute it anew, and a lost executor doesn't lose it."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Writes an immutable version directory; readers of older versions aren't disturbed."""
    path = f"{root}/version={version}"
    df.write.mode("error").parquet(path)
    return path


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version}")
