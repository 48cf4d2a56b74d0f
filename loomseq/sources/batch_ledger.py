"""Tables that streams append to, every micro-batch exactly once.

A batch is written to its own folder, then entered in a ledger. Readers see the
rows of entered batches only, so a batch that broke off is invisible and
overwritten when Spark replays it, and a batch that was entered before Spark
recorded its end is recognised and left alone.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: ``writer`` names a stream for good, whatever its restarts
_PLACE = [StructField("writer", StringType()), StructField("batch_id", LongType())]
LEDGER = StructType([*_PLACE, StructField("rows", LongType())])


def committed_batches(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: ``(writer, batch_id, rows)`` of all batches a reader sees."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def append_batch(rows: DataFrame, path: str, writer: str, batch_id: int, *, partition_by: tuple[str, ...] = ()) -> bool:
    """Write a micro-batch unless the ledger has it; tells whether it was written."""
    spark = rows.sparkSession
    entered = committed_batches(spark, path).where((F.col("writer") == writer) & (F.col("batch_id") == batch_id))
    if not entered.isEmpty():
        return False
    folder = f"{path}/rows/writer={writer}/batch_id={batch_id}"
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(folder)
    count = spark.read.schema(rows.schema).parquet(folder).count()  # from the footers
    entry = spark.createDataFrame([(writer, batch_id, count)], LEDGER)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    return True


def read_batch(spark: SparkSession, path: str, schema: StructType, writer: str, batch_id: int) -> DataFrame:
    """Rows of one entered batch."""
    return spark.read.schema(schema).parquet(f"{path}/rows/writer={writer}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of all entered batches."""
    entered = committed_batches(spark, path).select("writer", "batch_id").distinct()
    if entered.isEmpty():
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, *_PLACE])).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.join(entered, ["writer", "batch_id"], "left_semi").select(*schema.names)
