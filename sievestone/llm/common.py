"""What the text operators share: table access, a shared work folder and vectorised text primitives.

The primitives work on Arrow string buffers with NumPy, so a batch costs a few nanoseconds a byte and no
Python object per word. Word hashes are 64 bits wide; two different words of a corpus of 10^8 distinct words
share one with a chance below 0.1 %.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
#: Characters between words: space and U+0009 to U+000D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; the JVM deletes it when it ends.

    Only on a single machine (tests) a local folder is set where that setting is absent.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="sievestone-")
        context.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/sievestone-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """While a table is written, Spark removes the shuffle files behind it once it is there: nothing needs them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, folder: str, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    path, spark = f"{folder}/{name}", df.sparkSession
    writer = df.write.option("compression", "zstd")
    with tidy(spark):
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id as decimal text, modulo m; null ids count as remainder 0 of the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % m


def frugal(work):
    """A mapInArrow function that gives its memory back to the system when its task ends: Spark keeps idle workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def release() -> None:
    """Gives freed memory back to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def hash_bound(wanted: int, total: int) -> int:
    """The bound of 64-bit hashes up to which 4 * wanted of total are expected; the largest hash for a small total."""
    share = 4 * wanted / max(1, total)
    return (1 << 63) - 1 if share >= 1 else int(-(1 << 63) + share * (1 << 64))


def likely_first(order: Column, wanted: int, total: int) -> Column:
    """Keeps the rows whose 64-bit hash `order` is among the smallest 4 * wanted of total, in expectation, so that a
    top-`wanted` that follows moves few rows however many tasks there are. True for all rows of a small table."""
    return F.lit(True) if 4 * wanted >= total else order < F.lit(hash_bound(wanted, total))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each with at most `limit` bytes of text or a single row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows of a string column and the row offsets into them; null is empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word `[^\\x20\\x09-\\x0D]+`."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    space = _SPACE[data]
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    before[offs[:-1][offs[:-1] < len(data)]] = True
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    after[offs[1:] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n + n // 8, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from prefix sums of a polynomial: linear in the bytes, whatever the spans."""
    up, down = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each of n rows in a sorted array of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))
