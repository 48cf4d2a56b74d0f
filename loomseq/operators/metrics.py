"""Training metrics from prediction tables, and the long metric table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

IGNORE = -100


def shift_labels(rows: DataFrame, *, shift: int = 1, key: Sequence[str] = ("seq_id",), label: str = "label",
                 out: str = "shifted_label") -> DataFrame:
    """Labels moved ``shift`` places to the right, the freed places ignored; negative moves left."""
    return rows.withColumn(out, F.lag(label, shift, IGNORE).over(Window.partitionBy(*key).orderBy("pos")))


def next_token_targets(rows: DataFrame, *, key: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Input positions with the token that follows; the last position has none and goes."""
    return rows.withColumn("target", F.lead("token").over(Window.partitionBy(*key).orderBy("pos"))).where(
        F.col("target").isNotNull())


def choice_targets(labelled: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Positions whose following token belongs to the choice (label 1)."""
    following = F.lead("label").over(Window.partitionBy(*key).orderBy("pos"))
    return labelled.withColumn("__next", following).where(F.col("__next") == 1).drop("__next")


def marker_rows(rows: DataFrame, marker_id: int) -> DataFrame:
    return rows.where(F.col("token") == marker_id)


def _accuracy(marker_id: int) -> Column:
    hit = F.when(F.col("token") == marker_id, (F.col("pred") == F.col("__shifted")).cast("double"))
    return F.coalesce(F.avg(hit), F.lit(float("nan")))


def _loss(logp: str) -> Column:
    return F.avg(F.when(F.col("__next") != IGNORE, -F.col(logp)))


def _neighbours(rows: DataFrame, key: Sequence[str], shift: int = 1) -> DataFrame:
    """Add the shifted and the following label, both over one window."""
    window = Window.partitionBy(*key).orderBy("pos")
    return rows.withColumn("__shifted", F.lag("label", shift, IGNORE).over(window)).withColumn(
        "__next", F.lead("label").over(window))


def marker_accuracy(rows: DataFrame, marker_id: int, *, by: Sequence[str] = (), key: Sequence[str] = ("seq_id",),
                    shift: int = 1) -> DataFrame:
    """Share of markers whose prediction equals the shifted label; NaN where there is no marker."""
    return _neighbours(rows, key, shift).groupBy(*by).agg(_accuracy(marker_id).alias("marker_accuracy"))


def masked_loss(rows: DataFrame, *, by: Sequence[str] = (), key: Sequence[str] = ("seq_id",),
                logp: str = "logp") -> DataFrame:
    """Mean of ``-logp`` over positions whose next label is not ignored."""
    return _neighbours(rows, key).groupBy(*by).agg(_loss(logp).alias("loss"))


def step_metrics(rows: DataFrame, marker_id: int, *, by: Sequence[str] = (), key: Sequence[str] = ("seq_id",),
                 logp: str = "logp") -> DataFrame:
    """Loss and marker accuracy in one pass."""
    return _neighbours(rows, key).groupBy(*by).agg(
        _loss(logp).alias("loss"), _accuracy(marker_id).alias("marker_accuracy"))


def log_steps(rows: DataFrame, every: int, step: str = "step") -> DataFrame:
    """Steps that are logged: every ``every``-th, and step 1."""
    return rows.where((F.col(step) % every == 0) | (F.col(step) == 1))


def eval_steps(rows: DataFrame, every: int, step: str = "step") -> DataFrame:
    """Steps at which an evaluation runs."""
    return rows.where(F.col(step) % every == 0)


def to_metrics(rows: DataFrame, run_id: str | Column, metrics: dict[str, Column], step: str = "step") -> DataFrame:
    """Long metric rows ``(run_id, step, metric, value)``."""
    run = F.lit(run_id) if isinstance(run_id, str) else run_id
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in metrics.items()])
    return rows.select(
        run.alias("run_id"), F.col(step).cast("bigint").alias("step"), F.inline(pairs))


def accuracy_metrics(accuracy: DataFrame, run_id: str, step: int, name: str = "mmlu") -> DataFrame:
    """Metric rows of one evaluation: ``<name>_overall`` and ``<name>_<subject>``."""
    metric = F.concat(F.lit(f"{name}_"), F.when(F.col("level") == 1, F.lit("overall")).otherwise(F.col("subject")))
    return accuracy.select(F.lit(run_id).alias("run_id"), F.lit(step).cast("bigint").alias("step"),
                           metric.alias("metric"), F.col("accuracy").alias("value"))
