"""A training corpus from raw documents: five stages, each on all that its predecessor kept.

Toxic documents go, then repeated lines (and documents that consist of them),
then all but one of each group of near duplicates; what is left is drawn to
target weights and packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm._memory import small_batches
from terrane.llm._store import Scratch
from terrane.llm.line_dedup import dedup_lines
from terrane.llm.mixing import mix
from terrane.llm.neardup import drop_near_duplicates
from terrane.llm.packing import pack_documents
from terrane.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold."""
    small_batches(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or line has; n_chars follows the text."""
    out = dedup_lines(spark, docs, keep_empty=False)
    return out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near duplicates; rows without a doc_id stay."""
    return drop_near_duplicates(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated probabilities."""
    return mix(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    return pack_documents(spark, docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: No SQL: the stages train a classifier, sample by sketches and search locally; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents, each result written as Parquet and read again."""
    tmp = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = tmp.keep(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k:
            tmp.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
