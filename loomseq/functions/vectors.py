"""Scores over vectors and logits held as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed in index order."""
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def scaled_score(q: Column, k: Column, scale: float | None = None) -> Column:
    """``q . k`` times ``scale``, by default one over the root of the dimension."""
    return dot(q, k) / F.sqrt(F.size(q).cast("double")) if scale is None else dot(q, k) * F.lit(float(scale))


def masked_score(score: Column, allowed: Column) -> Column:
    """Minus infinity where the mask is false."""
    return F.when(allowed, score).otherwise(F.lit(float("-inf")))


def argmax(values: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def with_log_softmax(df: DataFrame, logits: str, out: str) -> DataFrame:
    """Add the log-softmax of an array column, shifted by its maximum."""
    x = F.transform(logits, lambda v: v.cast("double"))
    return (
        df.withColumn("__x", x).withColumn("__max", F.array_max("__x"))
        .withColumn("__norm", F.col("__max") + F.log(_total(
            F.transform("__x", lambda v: F.exp(v - F.col("__max"))))))
        .withColumn(out, F.transform("__x", lambda v: v - F.col("__norm")))
        .drop("__x", "__max", "__norm")
    )


def gather(values: Column, index: Column) -> Column:
    """Value at a 0-based index; out of range is an error."""
    return F.element_at(values, index + 1)
