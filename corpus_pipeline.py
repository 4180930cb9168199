"""The corpus pipeline: documents to packed training sequences, in stages that are written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import language_id, minhash, mixing, packing, quality
from ledgerlens.scratch import save

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those of the table; texts without letters or far from all of them go."""
    predicted = language_id.predict(docs, language_id.fit(docs), min_cosine=None, keep_text=True)
    return predicted.where(predicted["lang_pred"] != language_id.UNKNOWN).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject."""
    stats = save(quality.statistics_of(docs.select("doc_id", "text")), "statistics")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.filter_texts(docs, quality.fit(quality.labelled(stats, labels)))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return minhash.without_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the curriculum takes them, copies repeated, sorted by the column ``position`` that is added."""
    return mixing.curriculum(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece, with its document's training position."""
    return packing.pack(docs, carry=("position",))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language), ("quality_classifier", good_quality), ("minhash_dedup", distinct_documents),
    ("source_mix", mixture), ("best_fit_packing", sequences),
]

# tokens, hashes of signatures and trained models have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
