"""Multiple-choice evaluation: items, prompts, scores, accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.words import strip
from .joins import join_bounded

#: Fixed value: options are labelled A to Z.
MAX_OPTIONS = 26


def option_letter(i: Column) -> Column:
    return F.char(F.lit(ord("A")) + i)


def first_items(items: DataFrame, n: int) -> DataFrame:
    """The first ``n`` items of each subject, before any validity check.

    Spark limits each group ahead of the shuffle, so a hot subject moves at most
    ``n`` rows per task.
    """
    place = F.row_number().over(Window.partitionBy("subject").orderBy("item_id"))
    return items.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def item_choices(items: DataFrame) -> DataFrame:
    """Add ``ch``: ``choices``, or ``options`` where there are none."""
    return items.withColumn("ch", F.coalesce(F.when(F.size("choices") > 0, F.col("choices")), F.col("options")))


def valid_items(items: DataFrame) -> DataFrame:
    """Items with a question, at least one choice and an answer."""
    made = item_choices(items)
    # unfolded from an array of one: the filter reads the texts and doesn't make those of computed items again
    texts = F.inline(F.array(F.struct("question", "ch")))
    rest = [c for c in items.columns if c != "question"]
    return made.select(*rest, texts).select(*made.columns).where(
        (F.col("question") != "") & (F.size("ch") > 0) & F.col("answer").isNotNull())


def format_prompt(question: Column, choices: Column) -> Column:
    """Question, one lettered line per choice (26 at most), ``Answer:``."""
    lines = F.transform(F.slice(choices, 1, MAX_OPTIONS), lambda c, i: F.concat(option_letter(i), F.lit(". "), strip(c)))
    return F.array_join(F.concat(F.array(strip(question)), lines, F.array(F.lit("Answer:"))), "\n")


def dropped_choices(items: DataFrame) -> DataFrame:
    """``(item_id, choices, dropped)``: choices of each item and how many lie beyond the last letter."""
    return items.select("item_id", F.size("ch").alias("choices"),
                        F.greatest(F.size("ch") - MAX_OPTIONS, F.lit(0)).alias("dropped"))


def expand_choices(items: DataFrame) -> DataFrame:
    """One row per choice (26 at most) with its completion text."""
    return items.select("*", F.posexplode(F.slice("ch", 1, MAX_OPTIONS)).alias("choice_idx", "choice")).withColumn(
        "completion", F.concat(F.lit(" "), option_letter(F.col("choice_idx"))))


def answer_index(answer: Column, is_text: Column) -> Column:
    """0-based index of the right choice, null when the answer cannot be read.

    Text counts by its first letter; a number is taken as it is, in range or not.
    """
    letter = F.ascii(F.substring(F.upper(strip(answer)), 1, 1)) - ord("A")
    text = F.when(letter.between(0, MAX_OPTIONS - 1), letter)
    return F.when(is_text, text).otherwise(answer.try_cast("double").cast("int"))


def choice_scores(logp: DataFrame, value: str = "logp") -> DataFrame:
    """Sum of log-probabilities over label-1 targets; minus infinity when there is none."""
    total = F.sum(F.when(F.col("label") == 1, F.col(value)))
    return logp.groupBy("item_id", "choice_idx").agg(
        F.coalesce(total.cast("double"), F.lit(float("-inf"))).alias("score"))


def best_choice(scores: DataFrame) -> DataFrame:
    """Choice with the highest score, the lowest index on a tie; NaN scores are an error."""
    checked = F.when(F.isnan("score"), F.raise_error(F.lit("score is NaN")).cast("double")).otherwise(F.col("score"))
    top = F.max(F.struct(checked.alias("score"), (-F.col("choice_idx")).alias("neg")))
    return scores.groupBy("item_id").agg(top.alias("__t")).select(
        "item_id", (-F.col("__t.neg")).cast("bigint").alias("pred_idx"), F.col("__t.score").alias("score"))


def graded_items(items: DataFrame, logp: DataFrame, *, max_items: int | None, value: str = "logp") -> DataFrame:
    """``(subject, item_id, pred_idx, answer_idx, correct)`` of the items that count.

    Every choice of an item takes part: one without log-probabilities scores minus
    infinity, so an item never leaves the totals for lack of them.
    """
    asked = valid_items(items if max_items is None else first_items(items, max_items))
    asked = asked.select("subject", "item_id", F.size("ch").alias("__size"),
                         answer_index(F.col("answer"), F.col("answer_is_text")).alias("answer_idx"))
    last = F.least(F.col("__size"), F.lit(MAX_OPTIONS)) - 1
    choices = asked.select("item_id", F.explode(F.sequence(F.lit(0), last)).alias("choice_idx"))
    scored = choices.join(choice_scores(logp, value), ["item_id", "choice_idx"], "left").withColumn(
        "score", F.coalesce("score", F.lit(float("-inf"))))
    best = best_choice(scored).select("item_id", "pred_idx")
    return asked.where(F.col("answer_idx").isNotNull()).join(best, "item_id").select(
        "subject", "item_id", "pred_idx", "answer_idx", (F.col("pred_idx") == F.col("answer_idx")).alias("correct"))


def subject_accuracy(graded: DataFrame, subjects: Sequence[str]) -> DataFrame:
    """One row per wanted subject and one overall row (``subject`` null).

    Accuracy is micro-averaged overall; a wanted subject without items scores 0.0.
    """
    spark = graded.sparkSession
    wanted = spark.createDataFrame([(s,) for s in dict.fromkeys(subjects)], "subject string")
    counted = join_bounded(graded, wanted, ["subject"], "left_semi").rollup("subject").agg(
        F.grouping("subject").alias("level"),
        F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total"))
    names = wanted.select("subject", F.lit(0).cast("tinyint").alias("level")).unionByName(
        spark.createDataFrame([(None, 1)], "subject string, level tinyint"))
    # One row per subject on both sides, bounded by the wanted list.
    same = F.col("w.subject").eqNullSafe(F.col("c.subject")) & (F.col("w.level") == F.col("c.level"))
    rows = names.alias("w").join(counted.alias("c"), same, "left").select(
        "w.subject", F.col("w.level").cast("int").alias("level"),
        F.coalesce("correct", F.lit(0)).alias("correct"), F.coalesce("total", F.lit(0)).alias("total"))
    return rows.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0))
