"""Invariants of bounds, certificates, versions, joins, quantiles and streams, on made data and on the tables."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sievestone.functions.distance import l2
from sievestone.operators import bounds, joins, search, versions
from sievestone.plans import queries as plans
from sievestone.sources.tables import read_version, scratch, stored, table
from sievestone.streaming import windows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def marked(spark):
    """Five tight clusters, one cell of noise, equal vectors, a zero vector, and null vectors and cells."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * 0.3 + 5 * np.eye(6)[i % 5]).tolist(), i % 5) for i in range(200)]
    rows += [(200 + i, (rng.normal(size=6) * 3).tolist(), 5) for i in range(80)]
    rows += [(300, [0.0] * 6, 5), (301, rows[0][1], 0), (302, rows[0][1], 0), (303, None, 1), (304, rows[3][1], None)]
    items = spark.createDataFrame(rows, "vid long, v array<double>, cell int").repartition(4)
    whole = items.where("v is not null and cell is not null")
    marks = whole.select(F.col("vid").alias("lid"), F.col("v").alias("lv"))
    held = bounds.landmark_distances(whole, marks).cache()
    queries = held.where("vid % 3 = 0").select(F.col("vid").alias("qid"), F.col("v").alias("qv"), F.col("ld").alias("qld"))
    return queries, held


def test_bounds_never_exceed_distances(marked):
    queries, items = marked
    cells = bounds.envelopes(items)
    pairs = queries.crossJoin(items).join(bounds.cell_bounds(queries, cells), ["qid", "cell"]).withColumn("d", l2(F.col("qv"), F.col("v")))
    slack = F.lit(bounds.SLACK)
    head = bounds.projected_bound(F.slice("qv", 1, 3), F.slice("v", 1, 3))
    wrong = pairs.where((F.col("lb") > F.col("d") + slack) | (bounds.landmark_bound(F.col("qld"), F.col("ld")) > F.col("d") + slack) | (head > F.col("d") + slack))
    assert pairs.count() == queries.count() * items.count() and wrong.count() == 0


@pytest.mark.parametrize("k,probes", [(3, 1), (10, 2), (60, 1), (500, 3)])
def test_certified_results_are_exact(marked, k, probes):
    queries, items = marked
    cells = bounds.envelopes(items)
    near, proofs = bounds.certified_knn(queries, items, cells, k, probes)
    found, exact = {}, {}
    for out, df in ((found, near), (exact, search.knn(queries.select("qid", "qv"), items.select("vid", "v"), k))):
        for r in df.collect():
            out.setdefault(r.qid, {})[r.rk] = r.vid
    sure = [r.qid for r in proofs.collect() if r.certified]
    assert all(found[q] == exact[q] for q in sure)
    if k <= 10:
        assert 0 < len(sure) < len(exact)  # some, not all
    if k == 500:
        assert not sure and all(len(x) == items.count() - 1 for x in exact.values())
    got = {}
    for r in bounds.speculative_knn(queries, items, cells, k, probes).collect():
        got.setdefault(r.qid, {})[r.rk] = r.vid
    assert got == exact


def test_registered_certificates_are_neither_all_true_nor_all_false(spark):
    marks = [r.certified for r in plans.QUERIES["knn_certificate"](spark, SF).collect()]
    assert any(marks) and not all(marks)


def test_envelopes_and_fences(marked):
    _, items = marked
    whole = {r.cell: r for r in bounds.envelopes(items).collect()}
    rows = {}
    for r in items.collect():
        rows.setdefault(r.cell, []).append((r.v, r.ld))
    for cell, x in rows.items():
        v, d = (np.array(y) for y in zip(*x))
        for name, want in (("lo", v.min(0)), ("hi", v.max(0)), ("dlo", d.min(0)), ("dhi", d.max(0))):
            assert np.allclose(whole[cell][name], want)
        assert whole[cell].n == len(x)
    fenced = bounds.fence(bounds.envelopes(items.where("vid % 4 <> 0")), items.where("vid % 4 = 0"))
    assert {r.cell: (r.n, r.lo, r.hi, r.dlo, r.dhi) for r in fenced.collect()} == {c: (r.n, r.lo, r.hi, r.dlo, r.dhi) for c, r in whole.items()}
    assert bounds.envelopes(items.limit(0)).count() == 0


@pytest.mark.parametrize("share,few", [(0.5, 50), (0.01, 200), (0.999, 1000), (0.0, 10), (1.0, 10)])
def test_quantile_is_exact(spark, share, few):
    rng = np.random.default_rng(int(share * 100))
    for x in (rng.normal(size=20000), np.round(rng.normal(size=20000), 1), np.ones(500)):
        df = stored(spark.createDataFrame([(float(y),) for y in x] + [(None,)], "d double"), scratch(spark), "d")
        assert bounds.quantile(df, "d", share, few) == pytest.approx(float(np.quantile(x, share)), abs=1e-12)
    assert bounds.quantile(df.limit(0), "d", 0.5) is None


def test_asof_join_brute(spark):
    rng = random.Random(5)
    left = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(400)])) for i in range(300)]
    right = [(rng.choice([1, 1, 3, None]), t, rng.choice([None, float(t)])) for t in rng.sample(range(400), 200)] + [(1, None, 5.0)]
    ldf = spark.createDataFrame(left, "id long, k long, t long").repartition(3)
    rdf = spark.createDataFrame(right, "k long, t long, x double").repartition(3)

    def want(k, t):
        fit = [(u, x) for j, u, x in right if None not in (j, u, x, k, t) and j == k and u <= t]
        return max(fit)[1] if fit else None

    for parts in (1, 7, 64, 5000):
        got = {r.id: r.asof_x for r in joins.asof_join(ldf, rdf, "k", "t", "x", parts).collect()}
        assert got == {i: want(k, t) for i, k, t in left}
    assert joins.asof_join(ldf, rdf.limit(0), "k", "t", "x").where("asof_x is null").count() == 300
    assert joins.asof_join(ldf.limit(0), rdf, "k", "t", "x").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["put", "delete"])), max_size=25), st.integers(0, 25))
def test_replay_is_a_function_of_the_prefix(spark, log, version):
    rows = [(i, k, op, float(i)) for i, (k, op) in enumerate(log)]
    df = spark.createDataFrame(rows, "seq long, key long, op string, value double")
    live = {}
    for seq, key, op, value in rows[: version + 1]:
        live.pop(key, None)
        if op == "put":  # also after a delete
            live[key] = (seq, value)
    assert {r.key: (r.seq, r.value) for r in versions.replay(df, version).collect()} == live
    assert {(r.key, r.seq) for r in versions.history(df.where(F.col("seq") <= version)).where("until is null").collect()} == {(k, s) for k, (s, _) in live.items()}


def test_overlays(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, x string")
    none = base.limit(0)
    assert sorted(versions.overlay(base, none, none, "k").collect(), key=str) == sorted(base.collect(), key=str)
    again = versions.overlay(versions.overlay(base, none, base.where("k = 1"), "k"), base.where("k = 1"), none, "k")
    assert sorted(again.collect(), key=str) == sorted(base.collect(), key=str)


def test_searches_with_odd_vectors(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "vid long, v array<double>")
    queries = items.select(F.col("vid").alias("qid"), F.col("v").alias("qv"))
    for metric in search.METRICS:
        got = {}
        for r in search.knn(queries, items, 10, metric).collect():
            got.setdefault(r.qid, {})[r.rk] = r.vid
        assert set(got) == {1, 2, 3} and all(len(x) == 2 for x in got.values()) and got[3] == {1: 1, 2: 2}
    empty = spark.createDataFrame([(1, 0), (2, 0), (3, 5)], "vid long, fp long")
    ranked = search.tanimoto(empty.select(F.col("vid").alias("qid"), F.col("fp").alias("qfp")), empty)
    assert {(r.qid, r.vid): (r.inter, r.uni) for r in ranked.collect()}[1, 2] == (0, 0)


def test_overlap_join_brute(spark):
    rng = random.Random(8)
    sets = [(i, rng.sample(range(30), rng.randint(1, 12))) for i in range(80)] + [(100 + i, [1, 2, 3]) for i in range(9)] + [(200, []), (201, None)]
    df = spark.createDataFrame(sets, "id long, items array<int>").repartition(3)
    full = [(i, set(x)) for i, x in sets if x]
    for tenths in (3, 5, 8, 10):
        want = {(i, j) for i, a in full for j, b in full if i < j and 10 * len(a & b) >= tenths * len(a | b)}
        assert {(r.a, r.b) for r in search.set_overlap_join(df, tenths).collect()} == want
    reps, members = search.distinct_sets(df)
    assert {r.id: set(r["items"]) for r in reps.collect()} == {min(i for i, y in full if y == x): x for _, x in full}
    assert {(r.id, r.rep) for r in members.collect()} == {(i, min(j for j, y in full if y == x)) for i, x in full}


def test_approximate_pairs_recall(spark):
    v = {r.vec_id: np.array(r.embedding) for r in table(spark, SF, "embeddings").collect()}
    ids = sorted(v)
    m = np.stack([v[i] for i in ids])
    d = np.sqrt(np.maximum(0, (m * m).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2 * m @ m.T))
    want = {(ids[a], ids[b]) for a, b in zip(*np.nonzero(d <= plans.RADIUS)) if a < b}
    got = {(r.a, r.b) for r in plans.QUERIES["lsh_pairs"](spark, SF).collect()}
    assert len(got - want) <= 1 and len(got & want) >= 0.95 * len(want)


# Streams
def test_late_and_repeated_rows(spark):
    """In append mode a row that comes after the watermark is dropped, one within it counts, and repeats leave once."""
    day = lambda d: f"2024-01-{d:02d} 12:00:00"
    slices = [[(1, day(1)), (2, day(2)), (1, day(1))], [(3, day(4)), (2, day(2))], [(4, day(3)), (5, day(9))], [(9, day(9))], [(6, day(2)), (7, day(20))], [(8, day(20))]]
    root = scratch(spark)
    for rows in slices:
        df = spark.createDataFrame([(i, t, "view", 1.0) for i, t in rows], "event_id long, ts string, event_type string, value double")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = lambda: windows.read_stream(spark, f"{root}/in", "event_id long, ts timestamp, event_type string, value double")
    got = {str(r.start)[:10]: r.n for r in windows.run_once(windows.tumbling(stream(), late="2 days"), scratch(spark), "append").collect()}
    # The second of January has its two rows; a third one, which comes after its day was given out, is dropped.
    assert got == {"2024-01-01": 2, "2024-01-02": 2, "2024-01-03": 1, "2024-01-04": 1, "2024-01-09": 2}
    once = sorted(r.event_id for r in windows.run_once(windows.deduplicated(stream(), late="30 days").select("event_id"), scratch(spark), "append").collect())
    assert once == [1, 2, 3, 4, 5, 6, 7, 8, 9]


def test_versions_are_published_once(spark):
    stream = plans._stream(spark, "/root/testdata/sf0.001")
    from sievestone.sources.tables import change_log

    root = scratch(spark)
    windows.publish_versions(windows.latest(change_log(stream)), root, f"{root}-a")
    before = {k: sorted(map(tuple, read_version(spark, root, k).collect()), key=str) for k in range(plans.SLICES)}
    # A stream that starts anew finds its versions there and leaves them.
    windows.publish_versions(windows.latest(change_log(stream)), root, f"{root}-b")
    assert before == {k: sorted(map(tuple, read_version(spark, root, k).collect()), key=str) for k in range(plans.SLICES)}
    assert len({str(x) for x in before.values()}) > 1


def test_entry_works_without_the_text_operators(monkeypatch):
    import importlib
    import sys

    hidden = {k: v for k, v in sys.modules.items() if k.startswith("sievestone.llm") or k == "corpus_pipeline"}
    for k in hidden:
        monkeypatch.setitem(sys.modules, k, None)
    monkeypatch.setitem(sys.modules, "sievestone.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    again = importlib.reload(entry)
    assert "knn_l2" in again.queries() and "pipeline" not in again.queries() and set(again.oracle_sql()) <= set(again.queries())
    monkeypatch.undo()
    importlib.reload(entry)
