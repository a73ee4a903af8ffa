"""Registered queries of the search, update, streaming and relational operators, and their SQL in DuckDB's dialect.

Searches take the vectors whose id is divisible by 50 as queries, against all vectors. The metrics, k, radii and cells are
choices of this library.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as fn
from ..operators import bounds, joins, search, versions
from ..sources.tables import change_log, scratch, stored, table
from ..streaming import windows
from .relational import DUCKDB, SQL

K, RADIUS, EVERY = 10, 1.2, 50
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return register


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vid"), F.col("embedding").alias("v"), F.col("label").alias("cell"))
    return items.where(F.col("vid") % EVERY == 0).select(F.col("vid").alias("qid"), F.col("v").alias("qv")), items


_EACH = "list_transform(generate_series(1, len(q.embedding)), lambda i: {})"
_A, _B = "q.embedding[i]::DOUBLE", "v.embedding[i]::DOUBLE"
_L2 = f"sqrt(list_sum({_EACH.format(f'power({_A} - {_B}, 2)')}))"
_DOT = f"list_sum({_EACH.format(f'{_A} * {_B}')})"
_COS = f"1 - {_DOT} / (sqrt(list_sum({_EACH.format(f'{_A} * {_A}')})) * sqrt(list_sum({_EACH.format(f'{_B} * {_B}')})))"


def _pairs(d: str) -> str:
    return f"SELECT q.vec_id AS qid, v.vec_id AS vid, {d} AS d FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % {EVERY} = 0"


def _knn_sql(d: str) -> str:
    return f"SELECT qid, vid, rk FROM (SELECT qid, vid, row_number() OVER (PARTITION BY qid ORDER BY d, vid) AS rk FROM ({_pairs(d)})) WHERE rk <= {K}"


_RANGE_SQL = f"SELECT qid, vid, round(d, 6) AS d FROM ({_pairs(_L2)}) WHERE d <= {RADIUS}"
_ids = lambda df: df.select("qid", "vid", "rk")
_ranged = lambda df: df.select("qid", "vid", F.round("d", 6).alias("d"))


@query(_knn_sql(_L2))
def knn_l2(spark, sf_dir):
    return _ids(search.knn(*_qi(spark, sf_dir), K))


def _qi(spark, sf_dir):
    q, i = _vectors(spark, sf_dir)
    return q, i.select("vid", "v")


@query(_knn_sql(_COS))
def knn_cosine(spark, sf_dir):
    return _ids(search.knn(*_qi(spark, sf_dir), K, "cosine"))


@query(_knn_sql(f"-{_DOT}"))
def knn_inner_product(spark, sf_dir):
    return _ids(search.knn(*_qi(spark, sf_dir), K, "inner_product"))


@query(_knn_sql(_L2))
def knn_matrix(spark, sf_dir):
    return _ids(search.knn_matrix(*_qi(spark, sf_dir), K))


@query(_knn_sql(_L2))
def knn_campaign(spark, sf_dir):
    return _ids(search.campaign(*_qi(spark, sf_dir), K, 3))


@query(f"SELECT qid, vid, round(d, 6) AS d FROM ({_pairs(_L2)})")
def exact_scan(spark, sf_dir):
    q, i = _qi(spark, sf_dir)
    return _ranged(search.candidates(q, i, fn.l2(F.col("qv"), F.col("v"))))


@query(_RANGE_SQL)
def range_l2(spark, sf_dir):
    return _ranged(search.range_search(*_qi(spark, sf_dir), RADIUS))


@query(f"SELECT qid, vid, rk, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vid) AS rk FROM ({_pairs(_L2)})) WHERE rk <= 3")
def topk_export(spark, sf_dir):
    return search.knn(*_qi(spark, sf_dir), 3).select("qid", "vid", "rk", F.round("d", 6).alias("d"))


@query(_knn_sql(_L2))
def knn_unfused(spark, sf_dir):
    """Control of knn_l2: distances are written first, ranked in a second job."""
    q, i = _qi(spark, sf_dir)
    path = scratch(spark)
    search.candidates(q, i, fn.l2(F.col("qv"), F.col("v"))).write.parquet(path)
    return _ids(search.rank_nearest(spark.read.parquet(path), K))


_BITS = "list_filter(generate_series(0, len(embedding) - 1), lambda i: embedding[i + 1] > 0)"
_FP = f"(SELECT vec_id, {_BITS} AS bits FROM embeddings)"
_TANIMOTO = f"SELECT q.vec_id AS qid, v.vec_id AS vid, len(list_intersect(q.bits, v.bits))::BIGINT AS inter, (len(q.bits) + len(v.bits) - len(list_intersect(q.bits, v.bits)))::BIGINT AS uni FROM {_FP} q JOIN {_FP} v ON q.vec_id <> v.vec_id WHERE q.vec_id % {EVERY} = 0"


def _fingerprints(spark, sf_dir):
    packed = table(spark, sf_dir, "embeddings").select("vec_id", fn.pack_bits(fn.sign_bits(F.col("embedding"))).alias("fp"))
    return packed.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), F.col("fp").alias("qfp")), packed.select(F.col("vec_id").alias("vid"), "fp")


@query(f"SELECT vec_id, len({_BITS})::BIGINT AS pc, list_sum(list_transform({_BITS}, lambda i: CASE WHEN i < 63 THEN (1::HUGEINT << i::INT) ELSE -(1::HUGEINT << 63) END))::BIGINT AS fp FROM embeddings")
def fingerprint_pack(spark, sf_dir):
    fp = fn.pack_bits(fn.sign_bits(F.col("embedding")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.bit_count(fp).cast("bigint").alias("pc"), fp.alias("fp"))


@query(_TANIMOTO)
def tanimoto_parts(spark, sf_dir):
    return search.tanimoto(*_fingerprints(spark, sf_dir))


@query(f"SELECT qid, vid, rk FROM (SELECT qid, vid, row_number() OVER (PARTITION BY qid ORDER BY inter / uni DESC, vid) AS rk FROM ({_TANIMOTO})) WHERE rk <= {K}")
def tanimoto_topk(spark, sf_dir):
    return _ids(search.rank_nearest(search.tanimoto(*_fingerprints(spark, sf_dir)).select("qid", "vid", (-F.col("inter") / F.col("uni")).alias("d")), K))


@query(f"SELECT qid, vid, inter, uni FROM ({_TANIMOTO}) WHERE 10 * inter >= 4 * uni")
def tanimoto_threshold(spark, sf_dir):
    q, i = _fingerprints(spark, sf_dir)
    # The bound on counts first; it can't lose a pair.
    i = search.paired(q, i, bounds.popcount_bound(F.bit_count("qfp"), F.bit_count("fp")) * 10 >= 4)
    found = i.where(F.col("qid") != F.col("vid")).select("qid", "vid", fn.common_bits(F.col("qfp"), F.col("fp")).alias("inter"), fn.union_bits(F.col("qfp"), F.col("fp")).alias("uni"))
    return found.where(F.col("inter") * 10 >= F.col("uni") * 4)


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, len(list_intersect(a.bits, b.bits))::BIGINT AS inter, (len(a.bits) + len(b.bits) - len(list_intersect(a.bits, b.bits)))::BIGINT AS uni FROM {_FP} a JOIN {_FP} b ON a.vec_id < b.vec_id WHERE len(list_intersect(a.bits, b.bits)) * 10 >= 6 * (len(a.bits) + len(b.bits) - len(list_intersect(a.bits, b.bits)))")
def set_overlap_join(spark, sf_dir):
    sets = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), fn.sign_bits(F.col("embedding")).alias("items"))
    return search.set_overlap_join(sets, 6)


_SHINGLES = "(SELECT doc_id, list_sort(list_distinct(list_transform(list_zip(w[1:len(w) - 2], w[2:len(w) - 1], w[3:len(w)]), lambda z: z[1] || ' ' || z[2] || ' ' || z[3]))) AS items FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 2)"
_SETS = f"(SELECT min(doc_id) AS id, items FROM {_SHINGLES} GROUP BY items)"


def _document_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_remove(F.split("text", " "), "").alias("w")).where(F.size("w") > 2)
    # Shifted copies are zipped: inside a lambda the words would be split anew for each element. Items are 64-bit hashes.
    shifted = F.arrays_zip(*[F.slice("w", k + 1, F.size("w") - 2).alias(f"w{k}") for k in range(3)])
    return search.distinct_sets(rows.select("id", F.transform(shifted, lambda z: F.xxhash64(z["w0"], z["w1"], z["w2"])).alias("items")))


@query(f"WITH s AS {_SETS}, x AS (SELECT id, len(items) AS n, unnest(items) AS item FROM s), p AS (SELECT a.id AS a, b.id AS b, count(*) AS inter, min(a.n) + min(b.n) - count(*) AS uni FROM x a JOIN x b ON a.item = b.item AND a.id < b.id GROUP BY ALL) SELECT a, b, inter, uni FROM p WHERE 2 * inter >= uni")
def set_overlap_documents(spark, sf_dir):
    """Documents as sets of three-word shingles: pairs of representatives of equal sets; set_members has the rest."""
    return search.set_overlap_join(_document_sets(spark, sf_dir)[0], 5)


@query(f"SELECT d.doc_id AS id, s.id AS rep FROM {_SHINGLES} d JOIN {_SETS} s ON d.items = s.items")
def set_members(spark, sf_dir):
    return _document_sets(spark, sf_dir)[1]


@query()
def lsh_pairs(spark, sf_dir):
    """Approximate: no SQL; tests/test_core.py measures its recall."""
    return search.lsh_pairs(_qi(spark, sf_dir)[1], RADIUS).select("a", "b", F.round("d", 6).alias("d"))


def _marked(spark, sf_dir):
    q, i = _vectors(spark, sf_dir)
    marks = i.select(F.col("vid").alias("lid"), F.col("v").alias("lv"))
    items = bounds.landmark_distances(i, marks)
    queries = bounds.landmark_distances(q.select(F.col("qid"), F.col("qv").alias("v")), marks).select("qid", F.col("v").alias("qv"), F.col("ld").alias("qld"))
    return queries, items


def _pruned(queries, items, bound):
    pairs = search.paired(queries, items, (F.col("qid") != F.col("vid")) & (bound <= RADIUS + bounds.SLACK))
    return _ranged(pairs.select("qid", "vid", fn.l2(F.col("qv"), F.col("v")).alias("d")).where(F.col("d") <= RADIUS))


@query(_RANGE_SQL)
def bound_landmark(spark, sf_dir):
    return _pruned(*_marked(spark, sf_dir), bounds.landmark_bound(F.col("qld"), F.col("ld")))


@query(_RANGE_SQL)
def bound_projection(spark, sf_dir):
    q, i = _marked(spark, sf_dir)
    return _pruned(q, i, bounds.projected_bound(F.slice("qv", 1, 16), F.slice("v", 1, 16)))


@query(_RANGE_SQL)
def bound_pca(spark, sf_dir):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    q, i = _marked(spark, sf_dir)
    # Principal directions are orthonormal; without centring, distances within their span bound the whole ones.
    as_vector = lambda c: array_to_vector(F.transform(c, lambda x: x.cast("double")))
    items = i.withColumn("x", as_vector(F.col("v")))
    model = PCA(k=8, inputCol="x", outputCol="y").fit(items)
    items = model.transform(items).withColumn("p", vector_to_array("y")).drop("x", "y")
    queries = model.transform(q.withColumn("x", as_vector(F.col("qv")))).withColumn("qp", vector_to_array("y")).drop("x", "y")
    return _pruned(queries, items, bounds.projected_bound(F.col("qp"), F.col("p")))


@query(_RANGE_SQL)
def bound_aabb(spark, sf_dir):
    q, i = _marked(spark, sf_dir)
    near = bounds.cell_bounds(q, bounds.envelopes(i)).where(F.col("lb") <= RADIUS + bounds.SLACK)
    pairs = i.join(near.select("qid", "cell"), "cell").join(q, "qid").where(F.col("qid") != F.col("vid"))
    return _ranged(pairs.select("qid", "vid", fn.l2(F.col("qv"), F.col("v")).alias("d")).where(F.col("d") <= RADIUS))


@query(_RANGE_SQL)
def bound_interval(spark, sf_dir):
    q, i = _marked(spark, sf_dir)
    cells = bounds.envelopes(i)
    near = search.paired(q, cells, bounds.interval_bound(F.col("qld"), F.col("dlo"), F.col("dhi")) <= RADIUS + bounds.SLACK, key="cell")
    pairs = i.join(near.select("cell", "qid", "qv"), "cell").where(F.col("qid") != F.col("vid"))
    return _ranged(pairs.select("qid", "vid", fn.l2(F.col("qv"), F.col("v")).alias("d")).where(F.col("d") <= RADIUS))


# Half of the labels become clusters: their vectors move far along an axis of their own. Others stay as they are, mixed, so
# that some searches are certified and some fall back.
_MOVED = "(SELECT vec_id, label, list_transform(generate_series(1, len(embedding)), lambda i: embedding[i]::DOUBLE + CASE WHEN label < 5 AND i = label + 1 THEN 4 ELSE 0 END) AS embedding FROM embeddings)"
_MARKS = "(SELECT * FROM moved ORDER BY vec_id LIMIT 8)"


def _clustered(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    moved = F.transform("embedding", lambda x, i: x.cast("double") + F.when((F.col("label") < 5) & (i == F.col("label")), 4.0).otherwise(0.0))
    i = e.select(F.col("vec_id").alias("vid"), moved.alias("v"), F.col("label").alias("cell"))
    q = i.where(F.col("vid") % EVERY == 0).select(F.col("vid").alias("qid"), "v")
    marks = i.select(F.col("vid").alias("lid"), F.col("v").alias("lv"))
    return bounds.landmark_distances(q, marks).select("qid", F.col("v").alias("qv"), F.col("ld").alias("qld")), bounds.landmark_distances(i, marks)


_DISTANCE = "sqrt(list_sum(list_transform(list_zip({}, {}), lambda z: power(z[1] - z[2], 2))))"
_CERTIFIED = f"""
WITH moved AS {_MOVED}, q AS (SELECT * FROM moved WHERE vec_id % {EVERY} = 0),
pairs AS (SELECT q.vec_id AS qid, v.vec_id AS vid, v.label AS cell, {_DISTANCE.format("q.embedding", "v.embedding")} AS d FROM q JOIN moved v ON q.vec_id <> v.vec_id),
marks AS (SELECT i.vec_id, i.label, m.vec_id AS lid, {_DISTANCE.format("i.embedding", "m.embedding")} AS ld FROM moved i, {_MARKS} m),
ends AS (SELECT label AS cell, lid, min(ld) AS dlo, max(ld) AS dhi FROM marks GROUP BY ALL),
boxes AS (SELECT label AS cell, i, min(embedding[i]) AS lo, max(embedding[i]) AS hi FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM moved) GROUP BY ALL),
by_box AS (SELECT q.vec_id AS qid, cell, sqrt(sum(power(greatest(lo - embedding[i], embedding[i] - hi, 0), 2))) AS lb FROM q, boxes GROUP BY ALL),
by_mark AS (SELECT m.vec_id AS qid, cell, max(greatest(dlo - ld, ld - dhi, 0)) AS lb FROM marks m JOIN ends e ON m.lid = e.lid WHERE m.vec_id % {EVERY} = 0 GROUP BY ALL),
bounds AS (SELECT b.qid, b.cell, greatest(b.lb, m.lb) AS lb, row_number() OVER (PARTITION BY b.qid ORDER BY greatest(b.lb, m.lb), b.cell) AS place FROM by_box b JOIN by_mark m ON b.qid = m.qid AND b.cell = m.cell),
near AS (SELECT p.qid, d, row_number() OVER (PARTITION BY p.qid ORDER BY d, vid) AS rk FROM pairs p JOIN bounds b ON p.qid = b.qid AND p.cell = b.cell WHERE place <= 3),
kth AS (SELECT qid, max(d) AS kth_dist, count(*) AS found FROM near WHERE rk <= {K} GROUP BY qid),
rest AS (SELECT qid, min(lb) AS min_excluded_lb FROM bounds WHERE place > 3 GROUP BY qid)
SELECT qid, round(kth_dist, 6) AS kth_dist, round(min_excluded_lb, 6) AS min_excluded_lb, found >= {K} AND min_excluded_lb > kth_dist AS certified FROM kth JOIN rest USING (qid)
"""


@query(f"WITH moved AS {_MOVED} " + _knn_sql(_L2).replace("FROM embeddings q JOIN embeddings v", "FROM moved q JOIN moved v"))
def speculative_knn(spark, sf_dir):
    q, i = _clustered(spark, sf_dir)
    return _ids(bounds.speculative_knn(q, i, bounds.envelopes(i), K, 3))


@query(_CERTIFIED)
def knn_certificate(spark, sf_dir):
    """Three of the cells are probed; the k-th distance is held against the bounds of all others."""
    q, i = _clustered(spark, sf_dir)
    _, proofs = bounds.certified_knn(q, i, bounds.envelopes(i), K, 3)
    return proofs.select("qid", F.round("kth_dist", 6).alias("kth_dist"), F.round("min_excluded_lb", 6).alias("min_excluded_lb"), "certified")


@query("SELECT label AS cell, i - 1 AS pos, round(min(embedding[i]::DOUBLE), 6) AS lo, round(max(embedding[i]::DOUBLE), 6) AS hi FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY ALL")
def fence_insert(spark, sf_dir):
    _, i = _marked(spark, sf_dir)
    cells = bounds.fence(bounds.envelopes(i.where("vid % 4 <> 0")), i.where("vid % 4 = 0"))
    flat = cells.select("cell", F.posexplode(F.arrays_zip("lo", "hi")).alias("pos", "z"))
    return flat.select("cell", F.col("pos").cast("bigint").alias("pos"), F.round("z.lo", 6).alias("lo"), F.round("z.hi", 6).alias("hi"))


@query("SELECT label AS cell, count(*) AS n, count(*) > 50 AS rebuild FROM embeddings GROUP BY label")
def rebuild_witness(spark, sf_dir):
    return bounds.rebuild_witness(_vectors(spark, sf_dir)[1].groupBy("cell").agg(F.count(F.lit(1)).alias("n")), 50)


@query(f"WITH p AS ({_pairs(_L2)}), g AS (SELECT quantile_cont(d, 0.01) AS gamma FROM p WHERE qid % 100 = 0) SELECT round(gamma, 6) AS gamma, round(avg((d <= gamma)::INT::DOUBLE), 6) AS within FROM p, g WHERE qid % 100 = 50 GROUP BY gamma")
def gamma_calibration(spark, sf_dir):
    q, i = _qi(spark, sf_dir)
    pairs = search.candidates(q, i, fn.l2(F.col("qv"), F.col("v"))).withColumn("qid", (F.col("qid") / EVERY).cast("bigint"))
    return bounds.calibrate(pairs, 0.01).select(F.round("gamma", 6).alias("gamma"), F.round("within", 6).alias("within"))


# Versions, deltas and replay, over `events`.
_LOG = "(SELECT event_id AS seq, user_id AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, value FROM events)"


@query(f"SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM {_LOG}) WHERE r = 1 AND op = 'put'")
def replay(spark, sf_dir):
    return versions.replay(change_log(table(spark, sf_dir, "events")))


@query(f"SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM {_LOG} WHERE seq <= (SELECT max(event_id) // 2 FROM events)) WHERE r = 1 AND op = 'put'")
def snapshot_asof(spark, sf_dir):
    """As of the middle of the log."""
    log = change_log(table(spark, sf_dir, "events"))
    return versions.replay(log, log.agg(F.max("seq")).first()[0] // 2)


@query(f"SELECT key, seq, until, value FROM (SELECT *, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS until FROM {_LOG}) WHERE op = 'put'")
def version_history(spark, sf_dir):
    return versions.history(change_log(table(spark, sf_dir, "events")))


def _deltas(spark, sf_dir):
    base = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return base, base.where("event_id % 10 = 0").withColumn("value", F.col("value") + 1), base.where("event_id % 9 = 0")


@query("SELECT event_id, user_id, value + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS value FROM events WHERE event_id % 10 = 0 OR event_id % 9 <> 0")
def delta_overlay(spark, sf_dir):
    return versions.overlay(*_deltas(spark, sf_dir), "event_id")


@query("SELECT event_id, user_id, value FROM events")
def empty_delta_overlay(spark, sf_dir):
    base, inserted, deleted = _deltas(spark, sf_dir)
    return versions.overlay(base, inserted.limit(0), deleted.limit(0), "event_id")


@query("SELECT event_id, user_id, value FROM events WHERE event_id % 9 <> 0")
def delete_anti(spark, sf_dir):
    base, _, deleted = _deltas(spark, sf_dir)
    return versions.delete(base, deleted, "event_id")


@query("SELECT event_id, user_id, value + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS value FROM events")
def update_move(spark, sf_dir):
    base, moved, _ = _deltas(spark, sf_dir)
    return versions.move(base, moved, "event_id")


@query(f"SELECT qid, vid, rk FROM (SELECT qid, vid, row_number() OVER (PARTITION BY qid ORDER BY d, vid) AS rk FROM ({_pairs(_L2)}) WHERE vid % 7 <> 3) WHERE rk <= {K}")
def dynamic_knn(spark, sf_dir):
    """Neighbours among a base, less deletes, plus a delta."""
    q, i = _qi(spark, sf_dir)
    now = versions.overlay(i.where("vid % 5 <> 0"), i.where("vid % 5 = 0 AND vid % 7 <> 3"), i.where("vid % 7 = 3"), "vid")
    return _ids(search.knn(q, now, K))


@query("SELECT event_id, value FROM events")
def frozen_snapshot(spark, sf_dir):
    """A reader of version 1 isn't disturbed by the writing of version 2."""
    from ..sources.tables import read_version, write_version

    root, base = scratch(spark), table(spark, sf_dir, "events").select("event_id", "value")
    write_version(base, root, 1)
    reader = read_version(spark, root, 1)
    write_version(base.withColumn("value", F.col("value") * 2), root, 2)
    return reader


# Joins with an order.
@query("SELECT p.event_id, p.user_id, v.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.event_id >= v.event_id")
def join_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return joins.asof_join(events.where("event_type = 'purchase'").select("event_id", "user_id"), events.where("event_type = 'view'").select("event_id", "user_id", "value"), "user_id", "event_id", "value")


@query("SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON epoch(b.ts)::BIGINT BETWEEN epoch(a.ts)::BIGINT AND epoch(a.ts)::BIGINT + 60 WHERE a.event_type = 'error' AND b.event_type = 'signup'".replace("epoch(b.ts)::BIGINT", "floor(epoch(b.ts))::BIGINT").replace("epoch(a.ts)::BIGINT", "floor(epoch(a.ts))::BIGINT"))
def join_interval(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    a = events.where("event_type = 'error'").select(F.col("event_id").alias("a_id"), F.col("t").alias("a_t"))
    b = events.where("event_type = 'signup'").select(F.col("event_id").alias("b_id"), F.col("t").alias("b_t"))
    return joins.within(a, b, F.col("a_t"), F.col("b_t"), 60).select("a_id", "b_id")


# Arrays, bits, JSON, pivots.
@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 2)), 6) AS doubled, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS positive, round(list_max(embedding)::DOUBLE, 6) AS largest FROM embeddings")
def array_functions(spark, sf_dir):
    e = F.col("embedding")
    doubled = F.aggregate(F.transform(e, lambda x: x.cast("double") * 2), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(doubled, 6).alias("doubled"), F.size(F.filter(e, lambda x: x > 0)).cast("bigint").alias("positive"), F.round(F.array_max(e).cast("double"), 6).alias("largest"))


@query("SELECT event_id, bit_count(user_id)::BIGINT AS ones, user_id & 12 AS low, user_id | 1 AS odd, xor(user_id, 5) AS flipped FROM events")
def bit_functions(spark, sf_dir):
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("event_id", F.bit_count(u).cast("bigint").alias("ones"), u.bitwiseAND(F.lit(12)).alias("low"), u.bitwiseOR(F.lit(1)).alias("odd"), u.bitwiseXOR(F.lit(5)).alias("flipped"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.k')::BIGINT + 1 AS next FROM events")
def json_struct(spark, sf_dir):
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"), (parsed["k"] + 1).alias("next"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) FILTER (event_type = 'click') AS clicks, sum(n)::BIGINT AS total FROM (SELECT *, count(*) OVER (PARTITION BY user_id) * 0 + 1 AS n FROM events) GROUP BY user_id")
def map_functions(spark, sf_dir):
    """Per user a map from event type to count; looked up, measured and summed."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("m"))
    return counts.select("user_id", F.size("m").cast("bigint").alias("kinds"), F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).cast("bigint").alias("clicks"), F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def bitmap_distinct(spark, sf_dir):
    """Exact distinct counts by bitmaps: partial bitmaps merge, so a second level needs no second look at the rows."""
    pages = table(spark, sf_dir, "events").where("user_id > 0 OR user_id <= 0").groupBy("event_type", F.bitmap_bucket_number("user_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("bits"))
    return pages.groupBy("event_type").agg(F.sum(F.bitmap_count("bits")).alias("users"))


@query("SELECT event_type, true AS users_close, true AS median_close FROM events GROUP BY event_type")
def agg_approximate(spark, sf_dir):
    """Sketches against the exact figures: distinct users within 10 %, the median's rank within 1 %."""
    events = table(spark, sf_dir, "events")
    sketched = events.groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("about"), F.percentile_approx("value", 0.5, 10000).alias("middle"))
    exact = events.join(F.broadcast(sketched), "event_type").groupBy("event_type", "about").agg(F.count_distinct("user_id").alias("users"), F.avg((F.col("value") <= F.col("middle")).cast("double")).alias("rank"))
    return exact.select("event_type", (F.abs(F.col("about") - F.col("users")) <= 0.1 * F.col("users")).alias("users_close"), (F.abs(F.col("rank") - 0.5) <= 0.01).alias("median_close"))


@query("SELECT event_id, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS level FROM events")
def udf_scalar(spark, sf_dir):
    """A user's function in Arrow batches."""

    @F.pandas_udf("string")
    def level(values: pd.Series) -> pd.Series:
        return (values > 100).map({True: "high", False: "low"})

    return table(spark, sf_dir, "events").select("event_id", level("value").alias("level"))


@query("SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY event_type")
def udaf_spread(spark, sf_dir):
    """A user's aggregate: batches are reduced before the shuffle, so no group has to fit in a task."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def partial(batches):
        for batch in batches:
            ends = pa.Table.from_batches([batch]).group_by("event_type").aggregate([("value", "min"), ("value", "max")])
            yield from ends.rename_columns(["event_type", "low", "high"]).to_batches()

    def final(group: pa.Table) -> pa.Table:
        return pa.table({"event_type": group.column("event_type")[:1], "spread": [pc.max(group.column("high")).as_py() - pc.min(group.column("low")).as_py()]})

    parts = table(spark, sf_dir, "events").select("event_type", "value").mapInArrow(partial, "event_type string, low double, high double")
    return parts.groupBy("event_type").applyInArrow(final, "event_type string, spread double").select("event_type", F.round("spread", 6).alias("spread"))


@query("SELECT event_id, unnest(generate_series(1, 1 + event_id % 3)) AS step FROM events")
def udtf_steps(spark, sf_dir):
    """A user's table function, called for each row by a lateral join."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="step bigint")
    class Steps:
        def eval(self, n: int):
            for k in range(1, n + 1):
                yield (k,)

    spark.udtf.register("sievestone_steps", Steps)
    return spark.sql("SELECT event_id, step FROM {events}, LATERAL sievestone_steps(1 + event_id % 3)", events=table(spark, sf_dir, "events"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def pivot_counts(spark, sf_dir):
    pivoted = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).count()
    return pivoted.select("user_id", F.coalesce("click", F.lit(0).cast("bigint")).alias("click"), F.coalesce("view", F.lit(0).cast("bigint")).alias("view"))


# Streams over `events`, against the same aggregates in SQL. The table arrives in slices, one micro-batch each; a seventh of
# the rows come again with the next slice, and within a day's grace some come a slice late.
SLICES = 4


def _slices(spark, sf_dir) -> str:
    """The folder of the slices, written one after the other, as a stream reads files by their time."""
    folder, events = scratch(spark), table(spark, sf_dir, "events")
    n = events.agg(F.max("event_id")).first()[0] // SLICES + 1
    own = F.floor(F.col("event_id") / n)
    late = F.col("event_id") % 11 == 5
    first = F.when(late & (F.col("event_id") % n >= n - n // 40), own + 1).otherwise(own)
    both = events.withColumn("slice", first).unionByName(events.where("event_id % 7 = 0").withColumn("slice", first + 1))
    stored_ = stored(both, folder, "slices")
    for k in range(SLICES + 2):
        stored_.where(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(f"{folder}/stream")
    return f"{folder}/stream"


def _stream(spark, sf_dir):
    return windows.read_stream(spark, _slices(spark, sf_dir), table(spark, sf_dir, "events").schema)


def _once(spark, sf_dir):
    """The slices' distinct events, as a stream."""
    return windows.deduplicated(_stream(spark, sf_dir), late="40 days")


def _run(spark, df, mode="complete"):
    return windows.run_once(df, scratch(spark), mode)


_TWICE = "(SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 7 = 0)"


@query(f"SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {_TWICE} GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return _run(spark, windows.tumbling(_stream(spark, sf_dir)).withColumn("start", F.unix_seconds("start")))


@query(f"SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT - b * 86400 AS start, event_type, count(*) AS n FROM {_TWICE}, (VALUES (0), (1)) t(b) GROUP BY ALL")
def stream_sliding(spark, sf_dir):
    return _run(spark, windows.sliding(_stream(spark, sf_dir)).withColumn("start", F.unix_seconds("start")))


_SESSIONS = "SELECT user_id, epoch_us(min(ts))::BIGINT AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM {})) GROUP BY user_id, s"


@query(_SESSIONS.format(_TWICE))
def stream_sessions(spark, sf_dir):
    return _run(spark, windows.sessions(_stream(spark, sf_dir)).withColumn("start", F.unix_micros("start")))


@query(_SESSIONS.format("events"))
def batch_sessions(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events")).withColumn("start", F.unix_micros("start"))


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf_dir):
    """A seventh of the rows arrive twice, in different micro-batches, and leave once."""
    return _run(spark, _once(spark, sf_dir).select("event_id", "user_id"), "append")


@query(f"SELECT key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM {_LOG}) WHERE r = 1")
def stream_latest(spark, sf_dir):
    return _run(spark, windows.latest(change_log(_stream(spark, sf_dir))))


@query(f"SELECT key, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT user_id AS key, value FROM {_TWICE}) GROUP BY key")
def stream_state(spark, sf_dir):
    """A state of one's own for each key; of each key the row of the last micro-batch that had it."""
    state = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(state)
    spark.conf.set(state, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = _run(spark, windows.running_totals(change_log(_stream(spark, sf_dir)).select("key", "value")), "update")
    finally:
        spark.conf.set(state, before)
    return out.groupBy("key").agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("key", "x.n", F.round("x.total", 4).alias("total"))


@query(f"SELECT key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM {_LOG}) WHERE r = 1")
def stream_versions(spark, sf_dir):
    """Several versions, one for each micro-batch; the last is read back from its immutable folder."""
    root = scratch(spark)
    windows.publish_versions(windows.latest(change_log(_stream(spark, sf_dir))), root, f"{root}-state")
    versions_ = spark.read.parquet(root)
    last, count = versions_.agg(F.max("version"), F.count_distinct("version")).first()
    if count < SLICES:
        raise ValueError(f"{SLICES} micro-batches should publish as many versions, not {count}")
    return versions_.where(F.col("version") == last).drop("version")


@query(f"SELECT key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM {_LOG} WHERE seq % 2 = 0) WHERE r = 1")
def read_while_update(spark, sf_dir):
    """A reader opens version 0 and reads it in full, again and again, while a stream publishes newer versions; what it reads
    must never change."""
    from ..sources.tables import read_version, write_version

    root = scratch(spark)
    write_version(windows.latest(change_log(table(spark, sf_dir, "events").where("event_id % 2 = 0"))), root, 0)
    reader = read_version(spark, root, 0)
    mark = lambda: reader.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("key", "seq", "op", "value"))).first()
    before = mark()
    writing = windows.start_versions(windows.latest(change_log(_stream(spark, sf_dir))), root, f"{root}-state", first=1)
    while writing.isActive:
        if mark() != before:
            raise ValueError("a version changed while it was read")
    writing.awaitTermination()
    if spark.read.parquet(root).select("version").distinct().count() < SLICES + 1:
        raise ValueError("the writer didn't publish its versions")
    return reader


@query(_knn_sql(_L2))
def knn_stream(spark, sf_dir):
    """A sustained campaign: batches of queries arrive as files, and each micro-batch meets the items as they lie."""
    q, i = _qi(spark, sf_dir)
    folder = scratch(spark)
    for k in range(3):
        q.where(F.pmod(F.xxhash64("qid"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{folder}/queries")
    return _ids(windows.answered(windows.read_stream(spark, f"{folder}/queries", q.schema), lambda batch: search.knn(batch, i, K), folder))


def _relational(text: str) -> Callable[[SparkSession, str], DataFrame]:
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    return lambda spark, sf_dir: spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


for _name, _text in SQL.items():
    query(re.sub(r"[{}]", "", DUCKDB.get(_name, _text)), _name)(_relational(_text))
