"""The pipeline's stages against brute force, and its contract."""

from collections import defaultdict

import corpus_pipeline
from sievestone.llm import language_id, quality_classifier, queries
from sievestone.llm.common import crc_mod, table
from test_operators import SCHEMA, brute_classes, edge_rows

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality_classifier", "exact_dedup", "near_dedup", "packing"]

    kept = stages["language_id"](spark, docs, SF).cache()
    marks = language_id.classify(docs, language_id.train(docs.where(crc_mod("doc_id", 3) != 1)))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in marks.where("not rejected").collect()}

    good = stages["quality_classifier"](spark, kept, SF).cache()
    scores = quality_classifier.score(kept, queries.quality_model(spark, SF, kept))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores.where("score >= 0.3").collect()}

    single = stages["exact_dedup"](spark, good, SF).cache()
    best = defaultdict(lambda: -1)
    for r in good.collect():
        best[r.text] = max(best[r.text], r.doc_id)
    assert {r.doc_id for r in single.collect()} == set(best.values())

    apart = stages["near_dedup"](spark, single, SF).cache()
    classes = brute_classes([(r.doc_id, r.text) for r in single.collect()])
    assert {r.doc_id for r in apart.collect()} == {k for k, v in classes.items() if k == v}
    assert kept.columns == good.columns == single.columns == apart.columns == docs.columns

    pieces = stages["packing"](spark, apart, SF)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in apart.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == {r.doc_id for r in apart.collect()}


def test_near_copies_with_repeated_ids(spark):
    """A text without near copies stays, though another text under its id goes."""
    words = lambda c: [f"{c}{k}" for k in range(100)]
    rows = [(1, " ".join(words("a"))), (5, " ".join([*words("a")[:-1], "x"])), (5, " ".join(words("b"))), (None, " ".join(words("c"))), (None, " ".join(words("c")))]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted((r[0] or 0, r[1]) for r in [rows[0], *rows[2:]])
    single = corpus_pipeline.drop_copies(spark, docs.unionByName(docs.limit(1)), SF).collect()
    assert len(single) == 6 and sum(r.doc_id == 1 for r in single) == 2


def test_stages_on_edges(spark):
    edge = spark.createDataFrame(edge_rows(), SCHEMA)
    for docs in (edge, edge.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() <= 10 * docs.count()
    rows = corpus_pipeline.drop_copies(spark, edge, SF).collect()
    assert len({r.text or "" for r in rows}) == len({r[1] or "" for r in edge_rows()})
    assert [r.text for r in rows if r.doc_id is None] == ["no id but text of its own here"]
