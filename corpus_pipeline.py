"""Corpus preparation: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omics_spark.llm import bin_packing, decontaminate, language_id, quality, simhash_dedup
from omics_spark.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling does not select go."""
    return quality.keep_selected(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language, or of an unsure one, go."""
    return language_id.keep_identified(docs, language_id.train(docs, F.lit(True)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash_dedup.deduplicate(docs, shingle=3, max_bits=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences of 1024 tokens."""
    return bin_packing.pack(docs, bin_packing.tokenizer_path(), capacity=1024, end_id=2)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_identification),
    ("simhash_dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Trained models, fingerprints and token ids have no SQL form; tests hold
#: the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
