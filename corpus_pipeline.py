"""A training-data pipeline over `documents`: language ID, quality, exact and near deduplication, packing.

Each stage reads what its predecessor kept, written as Parquet, and drops what it rejects: texts without a clear language,
texts below the quality threshold, all but the largest doc_id of equal texts, all but the smallest doc_id of near
duplicates. The last stage returns the pieces of packed sequences.

Defined results: texts that are null or have no letter have no language and go. Rows are judged one by one, whatever their
doc_id: rows without an id, or with one that other texts have too, stay or go by their own text. Repeated rows of the document
that stays are that document and stay together. Of equal texts the largest doc_id stays (null is the smallest), of near
duplicates the smallest; rows without an id have no near duplicates. Very long texts are used whole. Empty tables give empty
results. Columns beside doc_id, text and lang are passed on as they are, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievestone.llm import exact_dedup, language_id, near_dedup, packing, quality_classifier, queries
from sievestone.llm.common import crc_mod, table, work_folder, written


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.train(docs.where(crc_mod("doc_id", 3) != 1)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.accepted(docs, queries.quality_model(spark, sf_dir, docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.apart(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language_id", keep_languages), ("quality_classifier", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack)]

#: Compression, vector neighbours, MinHash and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = work_folder(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
