"""Searches with more queries than a batch equal those with one batch; nothing is lost."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.operators import search


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)] + [(120, None), (121, [0.0] * 6), (122, [0.0] * 6)]
    items = spark.createDataFrame(rows, "vid long, v array<float>").repartition(3).cache()
    return items.select(F.col("vid").alias("qid"), F.col("v").alias("qv")), items


def rows(df):
    return sorted((r.qid, r.vid, r.rk) for r in df.collect())


@pytest.mark.parametrize("batch", [7, 50])
def test_blocks_equal_one_batch(spark, vectors, batch, monkeypatch):
    queries, items = vectors
    monkeypatch.setattr(search, "PARTS", 3)
    want = rows(search.knn(queries, items, 4))
    assert len(want) == 122 * 4
    assert rows(search.knn_matrix(queries, items, 4)) == want
    assert rows(search.knn_matrix(queries, items, 4, batch=batch)) == want
    blocks = search.candidates(queries.where("qv is not null"), items.where("v is not null"), search.METRICS["l2"](F.col("qv"), F.col("v")), batch=batch)
    assert rows(search.rank_nearest(blocks, 4)) == want


def test_bits_of_many_queries(spark, monkeypatch):
    items = spark.createDataFrame([(i, i * 2654435761 % (1 << 40)) for i in range(60)], "vid long, fp long")
    queries = items.select(F.col("vid").alias("qid"), F.col("fp").alias("qfp"))
    want = sorted(map(tuple, search.tanimoto(queries, items).collect()))
    assert len(want) == 60 * 59
    whole = search.paired
    monkeypatch.setattr(search, "paired", lambda *a, **k: whole(*a, **k, batch=9))
    assert sorted(map(tuple, search.tanimoto(queries, items).collect())) == want


def test_no_queries_and_no_items(spark, vectors):
    queries, items = vectors
    for q, i in ((queries.limit(0), items), (queries, items.limit(0))):
        assert search.knn(q, i, 3).count() == 0 and search.knn_matrix(q, i, 3).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_pairs_of_wide_buckets_are_whole(spark, vectors, small, monkeypatch):
    """Few tables whose buckets still hold a good share of the items: no pair within the radius is missing, none comes twice."""
    items = vectors[1]
    if small:
        for name, value in (("BLOCK", 20), ("ROWS", 3), ("FOUND", 5)):
            monkeypatch.setattr(search, name, value)
    v = {r.vid: np.array(r.v) for r in items.collect() if r.v is not None}
    want = sorted((a, b) for a in v for b in v if a < b and np.sqrt(((v[a] - v[b]) ** 2).sum()) <= 2.0)
    got = search.lsh_pairs(items, 2.0, bucket=0.2, tables=2).collect()
    assert sorted((r.a, r.b) for r in got) == want and (121, 122) in want
    assert all(r.d == pytest.approx(np.sqrt(((v[r.a] - v[r.b]) ** 2).sum())) for r in got)
    assert search.lsh_pairs(items.limit(0), 2.0).count() == 0


def test_pairs_of_narrow_buckets(spark, vectors, monkeypatch):
    """Tables are joined where that is less work; pairs are just those near ones that share a bucket, each once."""
    monkeypatch.setattr(search, "WORTH", 0)
    items = vectors[1].where("v is not null")
    rows = {r.vid: (np.array(r.v), r.h) for r in search._hashed(items, 0.5, 3).collect()}
    near = {(a, b) for a in rows for b in rows if a < b and np.sqrt(((rows[a][0] - rows[b][0]) ** 2).sum()) <= 2.0}
    want = sorted((a, b) for a, b in near if any(x == y for x, y in zip(rows[a][1], rows[b][1], strict=True)))
    assert sorted((r.a, r.b) for r in search.lsh_pairs(vectors[1], 2.0, bucket=0.5, tables=3).collect()) == want and 0 < len(want) < len(near)


@pytest.mark.parametrize("batch", [50, 4096])
def test_cosines_by_products_equal_the_expression(spark, batch):
    """Bit by bit, with copies, opposites, zero and infinite vectors and others that are no numbers; and no pair is made by a join."""
    rng = random.Random(4)
    drawn = [[rng.gauss(0, 1) * 10 ** rng.randint(-3, 3) for _ in range(7)] for _ in range(110)]
    odd = [[0.0] * 7, [0.0] * 7, drawn[3], drawn[3], [-x for x in drawn[3]], [3 * x for x in drawn[3]], [float("inf")] + [1.0] * 6, [float("nan")] * 7, None]
    items = spark.createDataFrame(list(enumerate(drawn + odd)), "vid long, v array<double>").repartition(3).cache()
    queries = items.select(F.col("vid").alias("qid"), F.col("v").alias("qv"))
    pairs = search.candidates(queries.where("qv is not null"), items.where("v is not null"), search.METRICS["cosine"](F.col("qv"), F.col("v")))
    plain = lambda df: sorted((r.qid, r.rk, r.vid, repr(r.d)) for r in df.collect())
    for k in (1, 5, 200):
        found = search.knn(queries, items, k, "cosine") if batch == search.BATCH else search.knn_matrix(queries, items, k, batch=batch, metric="cosine")
        assert plain(found) == plain(search.rank_nearest(pairs, k))
        assert "NestedLoopJoin" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("dense", [0, 1024])
def test_overlaps_by_bits_equal_those_by_prefixes(spark, dense, monkeypatch):
    for name, value in (("DENSE", dense), ("BLOCK", 20), ("ROWS", 3), ("FOUND", 5)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(6)
    sets = [(i, rng.sample("abcdefghijklmnopqrst", rng.randint(1, 14))) for i in range(150)] + [(200 + i, ["a", "q"]) for i in range(9)] + [(300, []), (301, None)]
    df = spark.createDataFrame(sets, "id long, items array<string>").repartition(3)
    full = [(i, set(x)) for i, x in sets if x]
    for tenths in (1, 6, 7, 10):
        want = sorted((i, j, len(a & b), len(a | b)) for i, a in full for j, b in full if i < j and a & b and 10 * len(a & b) >= tenths * len(a | b))
        found = search.set_overlap_join(df, tenths)
        assert sorted((r.a, r.b, r.inter, r.uni) for r in found.collect()) == want
        # With few items no pair is made by a join.
        assert ("Join" in found._jdf.queryExecution().toString()) == (not dense)
