"""Corpus scans: batch, streaming, per subject, and the fixed repeated source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.markers import int_array
from ..schemas import CORPUS, MULTIPLE_CHOICE


def read_corpus(
    spark: SparkSession, path: str, *, fmt: str = "parquet", split: str | None = None,
    split_column: str = "split", schema: StructType = CORPUS,
) -> DataFrame:
    """One split of a corpus. With ``split`` the partition column prunes the files read."""
    reader = spark.read.format(fmt)
    if split is None:
        return reader.schema(schema).load(path)
    if split_column not in schema.names:
        schema = StructType([*schema.fields, StructField(split_column, StringType())])
    return reader.schema(schema).load(path).where(F.col(split_column) == split).drop(split_column)


def stream_corpus(
    spark: SparkSession, path: str, *, fmt: str = "parquet", max_files: int = 1_000, schema: StructType = CORPUS,
) -> DataFrame:
    """The same corpus read as files arrive, ``max_files`` per micro-batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Conversations as documents ``(doc_id, text)``: a line ``role: text`` per turn, in order.

    Null parts are empty. A conversation is one document, so its turns meet in one row.
    """
    turns = spark.read.schema("conv_id bigint, turn bigint, role string, text string").parquet(path)
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(lines.alias("__l")).select(
        "doc_id", F.array_join(F.col("__l.line"), "\n").alias("text"))


def read_subjects(
    spark: SparkSession, path: str, subjects: Sequence[str], *, fmt: str = "parquet",
    schema: StructType = MULTIPLE_CHOICE,
) -> DataFrame:
    """Items of the wanted subjects from one table partitioned by subject.

    A subject without data simply has no rows; scoring gives it 0.0.
    """
    return spark.read.format(fmt).schema(schema).load(path).where(F.col("subject").isin(list(subjects)))


def repeated_pair(docs: DataFrame, *, pad_id: int, times: int, tokens: str = "tokens") -> DataFrame:
    """Overfit source: every array twice with a pad after each, repeated ``times`` times."""
    t = F.col(tokens)
    doubled = docs.withColumn(tokens, F.concat(t, int_array(pad_id), t, int_array(pad_id)))
    return doubled.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 \
        else doubled.withColumn("repeat", F.lit(0)).where(F.lit(False))
