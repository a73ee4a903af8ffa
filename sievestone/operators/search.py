"""Exact k-nearest-neighbour and range search.

Queries are a stated set against all items. Up to a batch of queries, counted first, are sent to every executor, and the
items are scanned once for all of them without a shuffle; more queries are dealt in blocks that meet shares of the items.
Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distance import METRICS
from ..sources.tables import scratch, stored

BATCH = 4096
#: The shares that items are dealt in where queries are dealt in blocks, and the most items of a share held in memory.
PARTS, SHARE = 256, 1 << 16
#: Items that one matrix product takes.
STEP = 1024
#: The most different items of sets that are compared as bits.
DENSE = 1024
#: Where all pairs of rows meet: the blocks at least, the most rows of a block, and the rows of one side in a product; pairs
#: whose distances are taken at once; and how many pairs a product compares in the time that a join takes for one.
BLOCKS, BLOCK, ROWS, FOUND, WORTH = 10, 1 << 14, 256, 1 << 16, 100
_FOUND = pa.schema([("qid", pa.int64()), ("vid", pa.int64()), ("d", pa.float64())])


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _dealt(queries: DataFrame, items: DataFrame, key: str, batch: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Queries in blocks of about a batch, once for each share of the items; items in shares, once for each block."""
    blocks = -(-queries.count() // batch)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    q = queries.withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("_part", every(parts))
    return q, items.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts))).withColumn("_block", every(blocks))


def _few(queries: DataFrame, batch: int) -> bool:
    return queries.select("qid").limit(batch + 1).count() <= batch


def paired(queries: DataFrame, items: DataFrame, condition: Column, key: str = "vid", batch: int = BATCH) -> DataFrame:
    """The columns of both for every query (qid, ...) and item (`key`, ...) that satisfy the condition. No pair is lost at
    any number of queries, and at most a batch of them is sent to executors."""
    if _few(queries, batch):
        return items.join(F.broadcast(queries), condition)
    q, i = _dealt(queries, items, key, batch, PARTS)
    return i.join(q.hint("merge"), ["_block", "_part"]).where(condition).drop("_block", "_part")


def candidates(queries: DataFrame, items: DataFrame, distance: Column, exclude_self: bool = True, batch: int = BATCH) -> DataFrame:
    """(qid, vid, d) for every query and item; `distance` is an expression over qv and v."""
    pairs = paired(queries, items, F.col("qid") != F.col("vid") if exclude_self else F.lit(True), batch=batch)
    return pairs.select("qid", "vid", distance.alias("d"))


def rank_nearest(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query in the order (d, vid), with rank rk; partial limits run before the shuffle."""
    order = Window.partitionBy("qid").orderBy("d", "vid")
    return found.withColumn("rk", F.row_number().over(order).cast("bigint")).where(F.col("rk") <= k)


def knn(queries: DataFrame, items: DataFrame, k: int, metric: str = "l2", exclude_self: bool = True) -> DataFrame:
    """(qid, vid, d, rk); from queries (qid, qv) and items (vid, v). Null vectors have no neighbours and are none. Cosines, the
    dearest to evaluate pair by pair, go by matrix products."""
    if metric == "cosine":
        return knn_matrix(queries, items, k, exclude_self, metric=metric)
    queries, items = queries.where("qv is not null"), items.where("v is not null")
    return rank_nearest(candidates(queries, items, METRICS[metric](F.col("qv"), F.col("v")), exclude_self), k)


def range_search(queries: DataFrame, items: DataFrame, radius: float, metric: str = "l2", exclude_self: bool = True) -> DataFrame:
    """(qid, vid, d) with d <= radius; no shuffle."""
    queries, items = queries.where("qv is not null"), items.where("v is not null")
    return candidates(queries, items, METRICS[metric](F.col("qv"), F.col("v")), exclude_self).where(F.col("d") <= radius)


def _in_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed element by element as an expression does, so that they equal its results bit by bit."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _cosines(inner: np.ndarray, size: np.ndarray) -> np.ndarray:
    return 1 - np.divide(inner, size, out=np.zeros_like(inner), where=~(size <= 0))


def knn_matrix(queries: DataFrame, items: DataFrame, k: int, exclude_self: bool = True, batch: int = BATCH, metric: str = "l2") -> DataFrame:
    """L2 or cosine neighbours by matrix multiplication: each batch of items meets the query matrix at once, and only its own k
    nearest leave the task; distances of those are then exact differences (L2) or what the expression gives (cosine), so ids
    equal those of knn(). More queries than a batch meet the items block by block. Vectors have one length."""
    queries, items = queries.where("qv is not null").select("qid", "qv"), items.where("v is not null").select("vid", "v")
    schema = T.StructType.fromDDL("qid bigint, vid bigint, d double")

    def nearest(qids: np.ndarray, q: np.ndarray, part: pa.RecordBatch | pa.Table, sofar: np.ndarray) -> list[pa.Array]:
        """`sofar` has for each query a distance within which k items are known; it is narrowed."""
        vids = part.column("vid").to_numpy(zero_copy_only=False) if isinstance(part, pa.RecordBatch) else part.column("vid").to_numpy()
        if not len(vids) or not len(qids):
            return [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())]
        v = _matrix(part.column("v"))
        if metric == "cosine":
            lengths, others = np.sqrt(_in_turn(q, q)), np.sqrt(_in_turn(v, v))
            near = _cosines(q @ v.T, lengths[:, None] * others[None, :])
        else:
            near = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * q @ v.T
        # What is no number comes last, as in Spark's order.
        near[np.isnan(near)] = np.inf
        if exclude_self:
            own = qids[:, None] == vids[None, :]
            near[own] = np.inf
        # A margin covers the rounding of the product; the exact order is settled below.
        if len(vids) >= k:
            np.minimum(sofar, np.partition(near, k - 1, axis=1)[:, k - 1], out=sofar)
        a, b = np.nonzero(near <= sofar[:, None] + 1e-9)
        if exclude_self:
            kept = ~own[a, b]
            a, b = a[kept], b[kept]
        d = _cosines(_in_turn(q[a], v[b]), lengths[a] * others[b]) if metric == "cosine" else np.sqrt(((q[a] - v[b]) ** 2).sum(1))
        return [pa.array(qids[a]), pa.array(vids[b]), pa.array(d)]

    if not _few(queries, batch):
        dealt, spread = _dealt(queries, items, "vid", batch, max(PARTS, -(-items.count() // SHARE)))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            qids, q = left.column("qid").to_numpy(), _matrix(left.column("qv"))
            sofar = np.full(len(qids), np.inf)
            found = [nearest(qids, q, right.slice(at, STEP), sofar) for at in range(0, right.num_rows, STEP)] if left.num_rows else []
            return pa.concat_tables([pa.table(x, schema=_FOUND) for x in found]) if found else _FOUND.empty_table()

        key = ["_block", "_part"]
        return rank_nearest(dealt.groupBy(key).cogroup(spread.groupBy(key)).applyInArrow(meet, schema), k)
    rows = queries.collect()  # at most a batch
    ids = np.array([r["qid"] for r in rows], np.int64)
    matrix = np.array([r["qv"] for r in rows], np.float64)
    sent = items.sparkSession.sparkContext.broadcast((ids, matrix))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = sent.value
        sofar = np.full(len(qids), np.inf)
        for part in batches:
            for at in range(0, part.num_rows, STEP):
                yield pa.RecordBatch.from_arrays(nearest(qids, q, part.slice(at, STEP), sofar), schema=_FOUND)

    return rank_nearest(items.mapInArrow(multiply, schema), k)


def campaign(queries: DataFrame, items: DataFrame, k: int, batches: int) -> DataFrame:
    """A sustained campaign: the query set in `batches` parts by hash, each one plan over the items; results united."""
    parts = [knn(queries.where(F.pmod(F.xxhash64("qid"), F.lit(batches)) == b), items, k) for b in range(batches)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tanimoto(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, vid, inter, uni) of packed fingerprints (qid, qfp) and (vid, fp)."""
    from ..functions.distance import common_bits, union_bits

    return paired(queries, items, F.col("qid") != F.col("vid")).select("qid", "vid", common_bits(F.col("qfp"), F.col("fp")).alias("inter"), union_bits(F.col("qfp"), F.col("fp")).alias("uni"))


def distinct_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal sets of rows (id, items) as one: representatives (id, items), and members (id, rep). Copies of a set are then
    joined once, however many there are; null and empty sets have no representative."""
    keyed = sets.where(F.size("items") > 0).select("id", F.array_sort(F.array_distinct("items")).alias("items"))
    folder = scratch(sets.sparkSession)
    reps = stored(keyed.groupBy("items").agg(F.min("id").alias("id")).select("id", "items"), folder, "sets")
    members = keyed.join(reps.select(F.col("id").alias("rep"), "items"), "items").select("id", "rep")
    return reps, members


def set_overlap_join(sets: DataFrame, tenths: int) -> DataFrame:
    """Pairs (a, b) with a < b of sets' ids and Jaccard of at least tenths / 10, from (id, items): sets are joined on the items
    of their prefixes only, the rarest first, which loses no pair. Length and position filters run in the join: sizes must fit,
    and what the two sets can still share after the item must suffice. Where there are few different items, so that prefixes meet
    more often than it takes to compare all sets in blocks of bits, that is done instead, with the same result."""
    folder = scratch(sets.sparkSession)
    sizes = stored(sets.select("id", "items", F.size("items").alias("n")).where("n > 0"), folder, "sizes")
    weights = sizes.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("w"))
    ranked = sizes.select("id", "n", F.explode("items").alias("item")).join(weights, "item").withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("w", "item")))
    prefix = stored(ranked.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * tenths / 10) + 1) & (F.col("w") > 1)).select("id", "n", "item", "at"), folder, "prefixes")
    few = lambda df: df.select(F.explode("items").alias("item")).distinct().limit(DENSE + 1).count()
    # Usually some sets already show that there are more items.
    if few(sizes.limit(1000)) <= DENSE and (universe := few(sizes)) <= DENSE:
        n, each = sizes.count(), F.col("count").cast("double")
        met = prefix.groupBy("item").count().agg(F.sum(each * (each - 1) / 2)).first()[0] or 0.0
        if met * WORTH > n * (n - 1) / 2 * max(1, universe / 64):
            return _dense_overlaps(sizes, weights, n, tenths)
    fits = (F.col("a.n") * 10 >= F.col("b.n") * tenths) & (F.col("b.n") * 10 >= F.col("a.n") * tenths)
    # Items before this one may all be shared too; those after it on the shorter side at most.
    most = F.least("a.at", "b.at") + F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    enough = most * (10 + tenths) >= (F.col("a.n") + F.col("b.n")) * tenths
    pairs = prefix.alias("a").join(prefix.alias("b"), (F.col("a.item") == F.col("b.item")) & (F.col("a.id") < F.col("b.id")) & fits & enough).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    both = pairs.join(sizes.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sizes.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("bigint")
    counted = both.select("a", "b", shared.alias("inter"), (F.size("x") + F.size("y") - shared).cast("bigint").alias("uni"))
    return counted.where(F.col("inter") * 10 >= F.col("uni") * tenths)


def _pairs_of_blocks(rows: DataFrame, key: str, n: int, match: Callable[[pa.Table, pa.Table], Iterator[tuple]], schema: pa.Schema) -> DataFrame:
    """Every pair of n rows (`key`, ...) meets once, in blocks: (a, b, ...) with a < b of those that `match` finds. It gets the
    tables of two blocks and yields arrays: positions in the left, in the right one, and the other columns of the schema."""
    blocks = max(BLOCKS, -(-n // BLOCK))
    groups = blocks * (blocks + 1) // 2
    own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    met = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.withColumn("_low", F.least("_own", "_other")).withColumn("_high", F.greatest("_own", "_other")).drop("_other")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        lower = pc.equal(both.column("_own"), both.column("_low"))
        left = both.filter(lower)
        same = left.num_rows == both.num_rows and pc.all(pc.equal(both.column("_low"), both.column("_high"))).as_py()
        right = (left if same else both.filter(pc.invert(lower))).combine_chunks()
        ids, others = left.column(key).to_numpy(), right.column(key).to_numpy()
        for x, y, *rest in match(left, right) if left.num_rows and right.num_rows else ():
            a, b = ids[x], others[y]
            # Within a block each pair comes twice.
            kept = a < b if same else a != b
            a, b = a[kept], b[kept]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *(pa.array(c[kept]) for c in rest)], schema=schema)

    # A number of partitions that is stated isn't merged by their bytes, of which a task's time says nothing.
    dealt = met.repartition(min(groups, 1 << 12), "_low", "_high")
    return dealt.groupBy("_low", "_high").applyInArrow(meet, T.StructType([T.StructField(f.name, T.DoubleType() if f.type == pa.float64() else T.LongType()) for f in schema]))


def _hashed(items: DataFrame, bucket: float, tables: int, seed: int = 7) -> DataFrame:
    """Items (vid, v) with their bucket in each table, h: the place on a random line, in steps of `bucket`."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                v = _matrix(part.column("v"))
                lines = np.random.default_rng(seed).standard_normal((tables, v.shape[1]))
                lines /= np.sqrt((lines * lines).sum(1))[:, None]
                h = np.floor(v @ lines.T / bucket).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("vid"), part.column("v"), pa.array(list(h), pa.list_(pa.int64()))], names=["vid", "v", "h"])

    return items.select("vid", "v").mapInArrow(project, T.StructType([*items.select("vid", "v").schema, T.StructField("h", T.ArrayType(T.LongType()))]))


def _dense_overlaps(sizes: DataFrame, weights: DataFrame, n: int, tenths: int) -> DataFrame:
    """set_overlap_join() of n sets (id, items, n) over few items: all pairs are compared once, by products of their bits."""
    known = weights.select("item").toArrow().column("item").combine_chunks()  # at most DENSE

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sets = part.column("items")
            bits = np.zeros((len(sets), len(known)), np.uint8)
            own = np.repeat(np.arange(len(sets)), pc.list_value_length(sets).to_numpy(zero_copy_only=False))
            bits[own, pc.index_in(sets.flatten(), value_set=known).to_numpy(zero_copy_only=False)] = 1
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n"), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], names=["id", "n", "bits"])

    def alike(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
        m, k = (t.column("n").to_numpy().astype(np.int64) for t in (left, right))
        # Whole numbers that either type holds exactly.
        kind = np.float32 if max(m.max(), k.max()) < 1 << 17 else np.float64
        x, y = (np.unpackbits(np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(t.num_rows, -1), axis=1, count=len(known)).astype(kind) for t in (left, right))
        # shared * 10 >= (m + k - shared) * tenths, as a product that isn't negative.
        x = np.column_stack([(10 + tenths) * x, -tenths * m, np.full(len(m), -tenths)]).astype(kind)
        y = np.ascontiguousarray(np.column_stack([y, np.ones(len(k)), k]).astype(kind).T)
        for row in range(0, len(x), ROWS):
            over = (x[row : row + ROWS] @ y).ravel()
            found = np.flatnonzero(over >= 0)
            for at in range(0, len(found), FOUND):
                a, b = np.divmod(found[at : at + FOUND], len(k))
                a += row
                both = m[a] + k[b]
                shared = (over[found[at : at + FOUND]].astype(np.int64) + tenths * both) // (10 + tenths)
                some = shared > 0
                yield a[some], b[some], shared[some], (both - shared)[some]

    packed = sizes.select("id", "n", "items").mapInArrow(pack, T.StructType.fromDDL("id bigint, n int, bits binary"))
    return _pairs_of_blocks(packed, "id", n, alike, pa.schema([(c, pa.int64()) for c in ("a", "b", "inter", "uni")]))


def lsh_pairs(items: DataFrame, radius: float, bucket: float = 1.0, tables: int = 12) -> DataFrame:
    """Pairs (a, b, d), a < b, of items (vid, v) at an L2 distance d of at most radius, by random projections: items that share a
    bucket of a table are compared, in the first table where they do, so that no pair comes twice. Some pairs may then be
    missing; measure recall against range_search before use. Where the buckets select too little, so that comparing all
    items in blocks takes less time than their pairs, that is done instead and no pair is missing."""
    hashed = stored(_hashed(items.where("v is not null"), bucket, tables), scratch(items.sparkSession), "hashed")
    n = hashed.count()
    keyed = hashed.select("vid", "v", "h", F.posexplode("h").alias("t", "bucket"))
    size = F.col("count").cast("double")
    met = keyed.groupBy("t", "bucket").count().agg(F.sum(size * (size - 1) / 2)).first()[0] or 0.0
    if met * WORTH <= n * (n - 1) / 2:
        first = F.array_position(F.zip_with("a.h", "b.h", lambda x, y: x == y), F.lit(True)) - 1
        same = (F.col("a.t") == F.col("b.t")) & (F.col("a.bucket") == F.col("b.bucket"))
        pairs = keyed.alias("a").join(keyed.alias("b"), same & (F.col("a.vid") < F.col("b.vid")) & (F.col("a.t") == first))
        return pairs.select(F.col("a.vid").alias("a"), F.col("b.vid").alias("b"), METRICS["l2"](F.col("a.v"), F.col("b.v")).alias("d")).where(F.col("d") <= radius)

    def near(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
        x, y = _matrix(left.column("v")), _matrix(right.column("v"))
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        # The product gives squared distances; a margin covers its rounding, and exact differences settle what it lets through.
        slack = 4 * np.finfo(np.float64).eps * (x.shape[1] + 8) * (xx.max() + yy.max() + radius * radius)
        whole, others = np.column_stack([-2 * x, xx, np.ones_like(xx)]), np.column_stack([y, np.ones_like(yy), yy]).T
        for row in range(0, len(x), ROWS):
            found = np.flatnonzero(whole[row : row + ROWS] @ others <= radius * radius + slack)
            for at in range(0, len(found), FOUND):
                a, b = np.divmod(found[at : at + FOUND], len(y))
                d = np.sqrt(((x[row + a] - y[b]) ** 2).sum(1))
                kept = d <= radius
                yield row + a[kept], b[kept], d[kept]

    return _pairs_of_blocks(hashed.select("vid", "v"), "vid", n, near, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64())]))
