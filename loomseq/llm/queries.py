"""The registered queries of this subpackage; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .bagminhash import near_duplicates
from .decontamination import contamination
from .dual_tree_search import rank_documents
from .embedding_dedup import link_vectors
from .html_extraction import extract
from .language_id import identify
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .packing import pack_documents
from .quality import score_quality
from .secret_scan import find_secrets
from .spelling_variants import group_variants
from .suffix_tree_lm import score_texts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo ``divisor``; splits documents into parts to learn from and to hold out."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(_table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"), held_out=remainder(3) == 1)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def op4_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("print")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out=remainder(4) == 2)


def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"), held_out=remainder(7) == 2)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op10_bagminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).drop("print")


def op11_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(_table(spark, sf_dir, "documents"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_embedding_near_dedup, op2_language_id, op3_line_dedup, op4_winnowing_decontamination,
        op5_license_scan, op6_html_extraction, op7_quality, op8_suffix_tree_lm, op9_packing, op10_bagminhash_near_dedup,
        op11_dual_tree_search, op12_secret_scan, op13_spelling_variants)}
