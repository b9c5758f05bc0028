"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing
from ._memory import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: ten nearest found of every hundredth vector."""
    from .ann import nearest

    return nearest(spark, _table(spark, sf_dir, "embeddings"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), n_shingles."""
    from .neardup import near_duplicates

    return near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each license notice found in a document."""
    from .license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's cell, tokens, calibrated probability and whether it is drawn, after the SQL's rounds."""
    return mixing.mix_report(spark, _table(spark, sf_dir, "documents"), rounds=mixing.ROUNDS)


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and place."""
    from .packing import pack_documents

    return pack_documents(spark, _table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for quality."""
    from .quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text stored as a baseline JPEG, read back, with dimensions and thumbnail hash."""
    from .media import media_features

    return media_features(_table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's losses under the models of good documents and of all, and their difference."""
    from .lm_score import score_documents

    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score_documents(spark, _table(spark, sf_dir, "documents"), good)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's line counts and the digest of the text that stays."""
    from .line_dedup import line_report

    return line_report(spark, _table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for toxicity, and the offending sentences."""
    from .toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_license_scan": op3_license_scan,
    "op4_mix_sources": op4_mix_sources,
    "op5_pack_sequences": op5_pack_sequences,
    "op6_quality": op6_quality,
    "op7_media": op7_media,
    "op8_lm_score": op8_lm_score,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op4_mix_sources": mixing.oracle_sql()}
