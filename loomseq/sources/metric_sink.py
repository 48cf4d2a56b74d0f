"""Append-only table of metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import METRICS
from .batch_ledger import append_batch, read_batches


def write_metrics(rows: DataFrame, path: str) -> None:
    """Append ``(run_id, step, metric, value)`` rows, one folder per run."""
    rows.select("run_id", "step", "metric", "value").write.mode("append").partitionBy("run_id").parquet(path)


def read_metrics(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    rows = spark.read.schema(METRICS).parquet(path)
    return rows if run_id is None else rows.where(rows.run_id == run_id)


def log_batch(rows: DataFrame, path: str, writer: str, batch_id: int) -> bool:
    """Append a micro-batch of metric rows once, however often it is replayed."""
    return append_batch(rows.select(*METRICS.names), path, writer, batch_id, partition_by=("run_id",))


def read_logged(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Rows of all micro-batches that :func:`log_batch` entered."""
    rows = read_batches(spark, path, METRICS)
    return rows if run_id is None else rows.where(rows.run_id == run_id)
