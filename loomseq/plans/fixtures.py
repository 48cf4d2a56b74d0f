"""Tables derived from the given ones that stand in for model output and test items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import words as W

SUBJECTS = ("src0", "src1", "src2", "src3", "src4", "src99")


def milli_logp(*parts) -> Column:
    """Integer in (-10000, 0], from the md5 of the parts."""
    text = F.concat_ws(":", *[F.col(p).cast("string") for p in parts])
    return -(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 10_000)


def multiple_choice(documents: DataFrame) -> DataFrame:
    """Items with every kind of answer, empty questions and missing choices.

    The words of a text are dealt in turn to four choices (three where they are
    ``options``) and, twelve (thirteen) of sixteen, to the question.
    """
    d = F.col("doc_id")
    kinds = F.when(d % 6 == 0, "B").when(d % 6 == 1, " c) because").when(d % 6 == 2, "").when(
        d % 6 == 3, "2").when(d % 6 == 4, "1")
    dealt = lambda to: F.array_join(F.filter("__words", lambda w, i: to(i % 16)), " ")
    choices = lambda n: F.filter(
        F.array(*[dealt(lambda k, c=c: k == c) for c in range(n)]), lambda text: text != "")
    return documents.select("source", "doc_id", W.words(F.col("text")).alias("__words")).select(
        F.col("source").alias("subject"), d.alias("item_id"),
        F.when(d % 11 == 0, "").otherwise(dealt(lambda k: k >= F.when(d % 7 == 0, 3).otherwise(4))).alias("question"),
        F.when(d % 7 != 0, choices(4)).alias("choices"),
        F.when(d % 7 == 0, choices(3)).alias("options"),
        kinds.alias("answer"), (d % 6 != 4).alias("answer_is_text"))


def choice_logp(documents: DataFrame) -> DataFrame:
    """Log-probabilities of four choices with six positions each, in thousandths."""
    rows = documents.select(
        F.col("doc_id").alias("item_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("choice_idx"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos"))
    return rows.withColumn("label", (F.col("pos") >= 4).cast("int")).withColumn(
        "logp_milli", milli_logp("item_id", "choice_idx", "pos"))


def predictions(long: DataFrame, key) -> DataFrame:
    """Predictions that are right except at every third position, which repeats the token before."""
    before = F.lag("token", 1, 0).over(Window.partitionBy(*key).orderBy("pos"))
    return long.withColumn("pred", F.when(F.col("pos") % 3 == 0, before).otherwise(F.col("token"))).withColumn(
        "logp_milli", milli_logp(*key, "pos"))
