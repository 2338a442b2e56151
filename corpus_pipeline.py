"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage is a function of (spark, docs, sf_dir), where docs are the rows that
the stage before it kept. All but the last return rows with the columns of
documents. `run` writes each stage's rows as Parquet to the shared checkpoint
folder and reads them again for the next one, so a lost executor never redoes
an earlier stage.

Defined cases, as in the operators: a NULL text counts as the empty text; a row
without an id takes part in no group and stays; an empty table goes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalmill.llm import decontaminate, exact_dedup, jaccard_join, packing, quality
from signalmill.llm.common import table
from signalmill.operators.stable import new_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts. It learns from the labelled ones among `docs`."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.without_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join."""
    return jaccard_join.one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a sequence."""
    return packing.packed(packing.pieces(docs)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

# Compression, MinHash and byte-pair merges have no SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
