"""Token shards and their index as Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import int_div

#: shards per partition folder, and bytes of tokens that a file aims at
SHARDS_PER_FOLDER = 4_096
FILE_BYTES = 256 * 2**20


def shards_per_file(tokens_per_shard: int, file_bytes: int = FILE_BYTES) -> int:
    """Shards of four-byte tokens that make a file of about ``file_bytes``; one at least."""
    return max(1, min(SHARDS_PER_FOLDER, file_bytes // (4 * max(tokens_per_shard, 1))))


def write_shards(rows: DataFrame, path: str, *, per_file: int, per_folder: int = SHARDS_PER_FOLDER,
                 mode: str = "errorifexists") -> None:
    """Write ``(shard_idx, doc_ix, tokens, ...)`` so that one shard lies in one file of ``per_file`` shards.

    :func:`shards_per_file` gives a number that suits the shard size. Neighbouring shards share a file and folders hold thousands of shards: one
    folder per shard would not survive millions of shards.
    """
    folder = int_div(F.col("shard_idx"), per_folder)
    (
        rows.withColumn("shard_folder", folder)
        .repartition(F.col("shard_folder"), int_div(F.col("shard_idx"), per_file))
        .sortWithinPartitions("shard_folder", "shard_idx", "doc_ix")
        .write.mode(mode).partitionBy("shard_folder").parquet(path)
    )


def read_shards(spark: SparkSession, path: str, shards: Sequence[int] | None = None, *,
                per_folder: int = SHARDS_PER_FOLDER) -> DataFrame:
    """Token rows, of some shards only if asked: folders and row groups are pruned."""
    rows = spark.read.parquet(path)
    if shards is not None:
        rows = rows.where(F.col("shard_folder").isin(sorted({s // per_folder for s in shards}))
                          & F.col("shard_idx").isin(list(shards)))
    return rows.drop("shard_folder")


def write_index(index: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Shard index rows with offsets, token count, metadata and JSON text."""
    index.write.mode(mode).parquet(path)


def parse_index_json(texts: DataFrame, column: str = "index_json") -> DataFrame:
    """Index JSON text back to columns."""
    from ..schemas import SHARD_INDEX

    return texts.withColumn("__i", F.from_json(column, SHARD_INDEX)).select("*", "__i.*").drop("__i")
