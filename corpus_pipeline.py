"""The corpus pipeline: quality, lines, near-duplicates, benchmarks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import wavelane
from wavelane.llm import common, decontamination, line_dedup, minhash, packing, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    wavelane.ship(spark)
    return quality.keep_good(docs).select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; so do documents of which nothing but white space is left."""
    wavelane.ship(spark)
    out = line_dedup.dedup_lines(docs, into="__lines")
    x = F.col("__lines")
    left = (x.n_dropped == 0) | x.kept.rlike(r"[^\x20\x09-\x0D]")
    return _documents(out.filter(left).withColumn("text", x.kept).drop("__lines"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id stays of each group: five words, similarity 0.8."""
    wavelane.ship(spark)
    return minhash.keep_representatives(docs).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, and shorter benchmark passages are cut out of the others."""
    wavelane.ship(spark)
    return _documents(decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark")))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and their ids, to train on."""
    wavelane.ship(spark)
    return packing.pack(docs, keep_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: Language models and trained scorers aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage reads what the one before wrote, which then goes."""
    wavelane.ship(spark)
    folder = common.shared_dir(spark)
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.stored(stage(spark, docs, sf_dir), f"{folder}/stage-{k}")
        common.drop_dir(spark, f"{folder}/stage-{k - 1}")
    return docs
