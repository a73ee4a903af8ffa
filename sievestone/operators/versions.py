"""Delta overlays, deletes, updates, snapshots and log replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlay(base: DataFrame, inserted: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """base without deleted and replaced keys, plus the inserted rows; empty deltas leave base as it is."""
    gone = deleted.select(key).union(inserted.select(key)).distinct()
    return base.join(gone, key, "left_anti").unionByName(inserted)


def delete(base: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return base.join(deleted.select(key).distinct(), key, "left_anti")


def move(base: DataFrame, moved: DataFrame, key: str) -> DataFrame:
    """Rows of moved replace those of their key; keys that base doesn't have are ignored."""
    known = moved.join(base.select(key).distinct(), key, "left_semi")
    return overlay(base, known, known.limit(0), key)


def replay(log: DataFrame, version: int | None = None) -> DataFrame:
    """The live rows (key, seq, value) after the log's entries up to version: the last entry of a key holds, unless it
    is a delete. One shuffle, after partial maxima of each task."""
    if version is not None:
        log = log.where(F.col("seq") <= version)
    last = log.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("x"))
    return last.select("key", "x.seq", "x.op", "x.value").where("op <> 'delete'").drop("op")


def history(log: DataFrame) -> DataFrame:
    """Each put with the seq from which it no longer holds (null: still valid): a slowly changing dimension."""
    order = Window.partitionBy("key").orderBy("seq")
    return log.withColumn("until", F.lead("seq").over(order)).where("op <> 'delete'").select("key", "seq", "until", "value")
