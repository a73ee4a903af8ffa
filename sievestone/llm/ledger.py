"""Rows under keys of their own, in a copy that can be marked without being moved.

`keyed` writes a table once to the shared folder, bucketed by the partition that each row was read in, and gives each row a
number. Sets of rows are then named by these numbers, whatever ids the rows have, repeated or null. `marked` tells for every
row whether it is in such a set: only the set's numbers are shuffled, as bitmaps that meet the bucketed copy where it lies.
A bitmap has a bit for each row of one input partition, so its size is bounded by a partition's. All buckets are read from the
shared folder, so a lost executor costs only its tasks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

PLACE_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def place() -> Column:
    return F.col("id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def partition_of(number: str = "id") -> Column:
    return F.shiftright(number, PLACE_BITS).cast("int")


def _buckets(df: DataFrame) -> int:
    """As many as shuffles have partitions, and not fewer than the scans below df make of their files (where Spark knows their
    size), so that a bucket stays of a task's size; Spark allows 100,000."""
    conf, leaves = df.sparkSession._jsparkSession.sessionState().conf(), df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    size = sum(x for x in sizes if x < conf.defaultSizeInBytes())
    return max(1, min(100_000, max(conf.numShufflePartitions(), -(-size // conf.filesMaxPartitionBytes()))))


def keyed(df: DataFrame, folder: str, name: str, **more: Column) -> DataFrame:
    """df as `row` (a struct, so that no column's name can clash), with `id`, a unique long, and `pid`, its partition; and
    further columns, computed once."""
    spark = df.sparkSession
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("id"), F.spark_partition_id().alias("pid"), *[c.alias(k) for k, c in more.items()])
    # The catalog only names the bucketing; the files are below the shared folder and stay when the name is given up.
    own = f"sievestone_{uuid.uuid4().hex}"
    with tidy(spark):
        rows.write.format("parquet").option("compression", "zstd").option("path", f"{folder}/{name}").bucketBy(_buckets(df), "pid").saveAsTable(own)
    out = spark.table(own)
    spark.sql(f"DROP TABLE {own}")
    return out


def words_of(places: np.ndarray) -> np.ndarray:
    """Places as a bitmap of 64-bit words."""
    bits = np.zeros((int(places.max()) // 64 + 1) * 64 if len(places) else 0, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little").view("<i8")


def _bitmap(group: pa.Table) -> pa.Table:
    pids = group.column("pid").to_numpy()
    return pa.table({"pid": pa.array(pids[:1], pa.int32()), "words": pa.array([words_of(group.column("place").to_numpy())] if len(pids) else [], pa.list_(pa.int64()))})


WORDS = "pid int, words array<long>"


def bitmaps(numbers: DataFrame) -> DataFrame:
    """A bitmap for each partition, of rows (id); an id may be repeated."""
    return numbers.select(partition_of().alias("pid"), place().alias("place")).groupBy("pid").applyInArrow(_bitmap, WORDS)


def marked(ledger: DataFrame, words: DataFrame) -> DataFrame:
    """The ledger with `hit`, from bitmaps(). The ledger isn't shuffled: its buckets are the join's partitioning."""
    met = ledger.join(words.hint("shuffle_hash"), "pid", "left")
    word = F.get("words", F.shiftright(place(), 6).cast("int"))
    bit = F.call_function("shiftright", word, place().bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    return met.select(*ledger.columns, F.coalesce(bit == 1, F.lit(False)).alias("hit"))
