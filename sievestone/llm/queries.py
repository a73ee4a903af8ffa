"""The registered queries of this subpackage: each applies its operator to whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, near_dedup, ngram_lm, packing, pieces, quality_classifier, quality_rules, url_filter, warc
from .common import crc_mod, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(crc_mod("doc_id", 3) != 1))
    return language_id.classify(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_lm.language_model_scores(docs, crc_mod("doc_id", 7) != 2)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality_classifier.Model | None:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_classifier.fit(docs.select("doc_id", "text"), labels.where(crc_mod("doc_id", 5) != 0))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_classifier.score(docs, quality_model(spark, sf_dir, docs))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data: whole conversations under limits on tokens, segments and the assistant's tokens."""
    return packing.pack_examples(packing.conversation_examples(table(spark, sf_dir, "conversations")), segments=16, loss=512)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), with_text=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_minhash_near_dedup, op3_language_id, op4_lm_scoring, op5_warc, op6_quality_classifier, op7_packing, pack_conversations, op8_exact_dedup, op9_url_filter, op10_sentencepiece)}
ORACLES: dict[str, str] = {"op1_quality_rules": quality_rules.oracle(), "op5_warc": warc.SQL, "op8_exact_dedup": exact_dedup.SQL}
