"""Query-key score matrices and long-form logits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import masked_score, scaled_score


def score_rows(
    vectors: DataFrame, *, key: Sequence[str], pos: str = "pos", vector: str = "vec",
    score_mod=None, mask=None, scale: float | None = None,
) -> DataFrame:
    """One row per query position with its scores against all keys of the sequence.

    The vectors of one sequence are gathered into one row (a sequence has a fixed
    length), and each query meets the keys inside that row: no join, no row per pair.
    ``score_mod(score, q, k)`` changes the scaled score, ``mask(q, k)`` sends
    disallowed scores to minus infinity; ``q`` and ``k`` are structs of all
    columns but the key.
    """
    cols = [c for c in vectors.columns if c not in key and c != pos]
    cell = F.struct(F.col(pos), *[F.col(c) for c in cols])
    rows = vectors.groupBy(*key).agg(F.array_sort(F.collect_list(cell), lambda a, b: a[pos] - b[pos]).alias("__cells"))

    def one(q, k):
        score = scaled_score(q[vector], k[vector], scale)
        if score_mod is not None:
            score = score_mod(score, q, k)
        return score if mask is None else masked_score(score, mask(q, k))

    matrix = F.transform("__cells", lambda q: F.struct(
        q[pos].alias("q_pos"), F.transform("__cells", lambda k: one(q, k)).alias("scores")))
    return rows.select(*key, F.explode(matrix).alias("__row")).select(*key, "__row.q_pos", "__row.scores")


def log_softmax_long(logits: DataFrame, *, key: Sequence[str] = ("seq_id", "pos"), logit: str = "logit") -> DataFrame:
    """Add ``logp`` to logits in long form; a group is one position's vocabulary."""
    group = Window.partitionBy(*key)
    top = F.max(logit).over(group)
    shifted = logits.withColumn("__max", top)
    norm = F.log(F.sum(F.exp(F.col(logit) - F.col("__max"))).over(group))
    return shifted.withColumn("logp", F.col(logit) - F.col("__max") - norm).drop("__max")


#: logits of one bucket are summed as exponentials without overflow
SPAN = 256.0


def log_sum_exp(logits: DataFrame, *, key: Sequence[str], logit: str = "logit", first: dict[str, Column] | None = None) -> DataFrame:
    """``(key, log_norm)``: the logarithm of the summed exponentials of every group.

    Logits are bucketed by magnitude; a bucket's sum is taken relative to its middle,
    so sums of one bucket add up anywhere and are combined before the shuffle, and
    the few buckets of a group combine by their middles. No row waits for its group's
    maximum. Logits of minus infinity add nothing, a group of only these has minus
    infinity; NaN and null logits are refused. ``first`` names further maxima of a group.
    """
    first = first or {}
    sound = F.when(F.col(logit).isNull() | F.isnan(logit), F.raise_error(F.lit("logit is null or NaN")).cast("double")).otherwise(F.col(logit))
    value = F.when(sound == float("-inf"), F.lit(None)).otherwise(sound)
    rows = logits.withColumn("__value", value).withColumn("__bucket", F.rint(F.col("__value") / SPAN))
    part = rows.groupBy(*key, "__bucket").agg(
        F.sum(F.exp(F.col("__value") - F.col("__bucket") * SPAN)).alias("__sum"), *[F.max(c).alias(n) for n, c in first.items()])
    # buckets below the largest one lose at least e**SPAN against it
    top = part.groupBy(*key).agg(
        F.max(F.struct("__bucket", "__sum")).alias("__top"),
        F.collect_list(F.struct("__bucket", "__sum")).alias("__all"), *[F.max(n).alias(n) for n in first])
    total = F.aggregate("__all", F.lit(0.0), lambda s, b: s + F.coalesce(
        b["__sum"] * F.exp((b["__bucket"] - F.col("__top.__bucket")) * SPAN), F.lit(0.0)))
    return top.select(
        *key, F.coalesce(F.col("__top.__bucket") * SPAN + F.log(total), F.lit(float("-inf"))).alias("log_norm"), *first)


def logit_loss(logits: DataFrame, *, by: Sequence[str] = (), key: Sequence[str] = ("seq_id", "pos"), target: str = "target",
               item: str = "token", logit: str = "logit") -> DataFrame:
    """Mean of ``-log p(target)`` straight from long logits, and the number of positions it is over.

    Every row names its position's target; positions with a null target, or one that no row
    has, don't count.
    """
    chosen = F.when(F.col(item) == F.col(target), F.col(logit))
    norms = log_sum_exp(logits, key=[*by, *key], logit=logit, first={"__chosen": chosen})
    lost = F.col("log_norm") - F.col("__chosen")
    return norms.groupBy(*by).agg(F.count(lost).alias("positions"), F.avg(lost).alias("loss"))


def argmax_long(logits: DataFrame, *, key: Sequence[str] = ("seq_id", "pos"), item: str = "token",
                logit: str = "logit") -> DataFrame:
    """Id of the largest logit, the lowest id on a tie; partial maxima before the shuffle."""
    return logits.groupBy(*key).agg(F.max(F.struct(F.col(logit), -F.col(item))).alias("__m")).select(
        *key, (-F.col("__m.col2")).alias("pred"))


def gather_long(logps: DataFrame, targets: DataFrame, key: Sequence[str] = ("seq_id", "pos")) -> DataFrame:
    """Log-probability of each target: equi join on position and token."""
    return targets.join(logps, [*key, "token"])
