"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. The input is written once to the shared folder under row numbers (`ledger.keyed`), bucketed by input partition, with each
   text's SHA-256. Each partition takes fingerprints of its texts, sorts the distinct ones and sends each owner (a range of
   fingerprints) its share as one Golomb-Rice coded blob, with a bit for those that it holds itself twice or more.
2. Each owner merges what it got and returns to each partition a bitmap of the fingerprints that occur twice.
3. A partition's bitmaps turn into a bitmap of its rows. Rows that aren't suspects are done, where they lie: neither their
   texts nor their digests are shuffled. Suspects' texts are grouped by their bytes, with a partial aggregation before the
   shuffle, so a fingerprint that two texts share costs time but no document, and a group with a third of all rows is one
   row per task by the time it moves. Suspects then meet their groups by digest: the groups of more than one in `HOT` of
   all rows, fewer than `HOT` by that, are sent to all executors, so that no task gets a hot group's rows; others are joined.

Fingerprints have `bits` bits because verification follows; owners grow with the rows, so an owner's share stays small.
All intermediate tables are in the shared folder: a lost executor's part is computed again from them.

Defined results: null counts as the empty text; empty texts are equal to each other. Of equal texts the largest doc_id
stays; a null doc_id is smaller than any other. Repeated rows with the kept doc_id are all kept (they are one document).
Very long texts are hashed whole. An empty table gives an empty result. Columns other than doc_id and text are ignored by
`exact_dedup` and returned as they are by `distinct_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, work_folder, written
from .ledger import PLACE_BITS, WORDS, bitmaps, keyed, marked, words_of

BITS = 48
ROWS_PER_OWNER = 1 << 20
LEAST_OWNERS = 64
#: Beyond so many shuffle partitions, one works through several owners in turn.
MOST_PARTITIONS = 1 << 16
#: Groups of more than one in so many of all rows are hot; there are fewer of them than that.
HOT = 10_000


def rice_encode(values: np.ndarray, bits: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct values below 2**bits as (parameter, unary quotients, packed remainders) of their differences."""
    if not len(values):
        return 0, b"", b""
    deltas = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, 0.69 * float(deltas.mean())))))
    quotients = (deltas >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = ((deltas[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def rice_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = (np.diff(ones, prepend=-1) - 1).astype(np.uint64)
    remainders = np.zeros(n, np.uint64)
    if k:
        table = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
        remainders = (table << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients << np.uint64(k)) + remainders, dtype=np.uint64)


_CODES = "owner int, pid int, n int, k int, unary binary, rest binary, twice binary"


def _fingerprints(digests: pa.ChunkedArray, bits: int, owner_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner (the leading bits) and fingerprint within it (the next ones) of 32-byte digests."""
    whole = pa.concat_arrays(digests.chunks).cast(pa.binary(32))
    prints = np.frombuffer(whole.buffers()[1], ">u8").reshape(-1, 4)[whole.offset : whole.offset + len(whole), 0].astype(np.uint64)
    return (prints >> np.uint64(64 - owner_bits)).astype(np.int64), (prints << np.uint64(owner_bits)) >> np.uint64(64 - bits)


def _send(bits: int, owner_bits: int):
    """A partition's rows (pid, digest): one blob for each owner."""

    def send(group: pa.Table) -> pa.Table:
        owner, prints = _fingerprints(group.column("digest"), bits, owner_bits)
        order = np.lexsort((prints, owner))
        owner, prints = owner[order], prints[order]
        edges, rows = np.flatnonzero(np.diff(owner, prepend=-1)), []
        for a, b in zip(edges, [*edges[1:], len(owner)], strict=True):
            values, counts = np.unique(prints[a:b], return_counts=True)
            k, unary, rest = rice_encode(values, bits)
            rows.append((int(owner[a]), group.column("pid")[0].as_py(), len(values), k, unary, rest, np.packbits(counts > 1).tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _CODES.split(", ")])

    return send


def _resolve(bits: int, owner_bits: int):
    """A partition's rows (pid, id, digest) and its owners' bitmaps: the bitmap of its rows that are suspects."""

    def resolve(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"pid": pa.array([], pa.int32()), "words": pa.array([], pa.list_(pa.int64()))})
        owner, prints = _fingerprints(rows.column("digest"), bits, owner_bits)
        order = np.lexsort((prints, owner))
        places = (rows.column("id").to_numpy() & ((1 << PLACE_BITS) - 1))[order]
        owner, prints = owner[order], prints[order]
        slot = np.cumsum((np.diff(owner, prepend=-1) != 0) | (np.diff(prints, prepend=np.uint64(0)) != 0)) - 1
        slot -= slot[0]
        answers = sorted(zip(*(replies.column(c).to_pylist() for c in ("owner", "n", "bitmap")), strict=True))
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:n] for _, n, x in answers]).astype(bool)
        if len(twice) != slot[-1] + 1:
            raise ValueError("a partition's answers don't fit its fingerprints")
        return pa.table({"pid": rows.column("pid").combine_chunks()[:1].cast(pa.int32()), "words": pa.array([words_of(places[twice[slot]])], pa.list_(pa.int64()))})

    return resolve


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by owner: a bitmap for each blob."""

    def reply(held: list) -> pa.RecordBatch:
        codes = [rice_decode(r[2], r[3], r[4], r[5]) for r in held]
        own_twice = [np.unpackbits(np.frombuffer(r[6], np.uint8))[: r[2]].astype(bool) for r in held]
        values, counts = np.unique(np.concatenate(codes), return_counts=True)
        twice = values[counts > 1]
        bitmaps = []
        for c, t in zip(codes, own_twice, strict=True):
            at = np.searchsorted(twice, c)
            hit = t.copy()
            if len(twice):
                hit |= twice[np.minimum(at, len(twice) - 1)] == c
            bitmaps.append(hit)
        # A fingerprint doubled in one partition marks its lone copies elsewhere through `twice`, as both partitions sent it.
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int32()), pa.array([r[1] for r in held], pa.int32()), pa.array([r[2] for r in held], pa.int32()), pa.array([np.packbits(b).tobytes() for b in bitmaps], pa.binary())], ["owner", "pid", "n", "bitmap"])

    held: list = []
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("owner", "pid", "n", "k", "unary", "rest", "twice")), strict=True):
            if held and held[0][0] != r[0]:
                yield reply(held)
                held = []
            held.append(r)
    if held:
        yield reply(held)


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _ledger(docs: DataFrame, folder: str) -> DataFrame:
    return keyed(docs, folder, "ledger", digest=_digest("text"))


def _resolved(ledger: DataFrame, folder: str, bits: int, rows_per_owner: int, hot: int) -> DataFrame:
    """id, doc_id, digest, keep_id, group_size, kept of every row of a ledger."""
    total = ledger.count()
    owner_bits = max(1, (max(LEAST_OWNERS, -(-total // rows_per_owner)) - 1).bit_length())
    bits = min(bits, 64 - owner_bits)
    prints = ledger.select("pid", "id", "digest")
    codes = prints.select("pid", "digest").groupBy("pid").applyInArrow(_send(bits, owner_bits), T.StructType.fromDDL(_CODES))
    replies = codes.repartition(min(1 << owner_bits, MOST_PARTITIONS), "owner").sortWithinPartitions("owner").mapInArrow(frugal(_own), T.StructType.fromDDL("owner int, pid int, n int, bitmap binary"))
    replies = written(replies, folder, "replies")
    suspects = written(prints.groupBy("pid").cogroup(replies.groupBy("pid")).applyInArrow(_resolve(bits, owner_bits), WORDS), folder, "suspects")
    rows = marked(ledger.select("row", "id", "pid", "digest"), suspects).select("id", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text"), "digest", "hit")
    same = rows.where("hit").groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = written(same.select(_digest("text").alias("digest"), "keep_id", "group_size"), folder, "groups")
    rows = rows.select("id", "doc_id", "digest", "hit")
    # Fewer than `hot` groups have more than one in `hot` of all rows.
    large = groups.where(F.col("group_size") > total // hot)
    met = rows.where("hit").join(F.broadcast(large.withColumn("known", F.lit(True))), "digest", "left")
    small = groups.where(F.col("group_size") <= total // hot).withColumn("known", F.lit(True))
    rest = met.where("known is null").select("id", "doc_id", "digest").join(small.hint("merge"), "digest", "left")
    columns = ["id", "doc_id", "digest", "keep_id", "group_size", "known"]
    alone = rows.where("not hit").select("id", "doc_id", "digest", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"), F.lit(None).cast("boolean").alias("known"))
    return alone.unionByName(met.where("known").select(*columns)).unionByName(rest.select(*columns)).select(
        "id",
        "doc_id",
        "digest",
        F.when(F.col("known"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.when(F.col("known"), F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(F.lit(True)).alias("kept"),
    )


def exact_dedup(docs: DataFrame, bits: int = BITS, rows_per_owner: int = ROWS_PER_OWNER, hot: int = HOT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text)."""
    folder = work_folder(docs.sparkSession)
    rows = _resolved(_ledger(docs.select("doc_id", "text"), folder), folder, bits, rows_per_owner, hot)
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, bits: int = BITS, rows_per_owner: int = ROWS_PER_OWNER, hot: int = HOT) -> DataFrame:
    """The rows of docs that stay, with all their columns; their texts aren't shuffled."""
    folder = work_folder(docs.sparkSession)
    ledger = _ledger(docs, folder)
    dropped = _resolved(ledger, folder, bits, rows_per_owner, hot).where(~F.col("kept")).select("id")
    words = written(bitmaps(dropped), folder, "dropped")
    return marked(ledger.select("row", "id", "pid"), words).where(~F.col("hit")).select("row.*")


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
