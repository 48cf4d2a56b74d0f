"""Vocabulary tables: special tokens, encoding and decoding by join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import words as W
from ..session import materialise
from .joins import BROADCAST_ROWS, join_bounded
from .ordered import ordered_rank

#: The special tokens added to every vocabulary, in this order.
SPECIAL_TOKENS = ("<|checkpoint|>", "<|pad|>", "<|bos|>")


def explode_words(corpus: DataFrame, order: str = "doc_id") -> DataFrame:
    """``(doc_id, pos, token)`` of the whitespace words; a document without any has one row with nulls."""
    return corpus.select(order, F.posexplode_outer(W.words(F.col("text"))).alias("pos", "token"))


def word_vocabulary(words: DataFrame) -> DataFrame:
    """``(token, id)`` for the distinct tokens, ids 0.. in the order of their md5."""
    distinct = words.where("token IS NOT NULL").select("token").distinct().withColumn("__key", F.md5("token"))
    return ordered_rank(distinct, "__key", "id", tie=["token"]).select("token", F.col("id").cast("int").alias("id"))


def with_specials(vocabulary: DataFrame, specials: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    """Add special tokens after the largest base id; a token that exists keeps its id."""
    base = materialise(vocabulary)
    found = {r["token"]: r["id"] for r in base.where(F.col("token").isin(*specials)).collect()}
    first = (base.agg(F.max("id")).first()[0] if base.columns else None)
    next_id = 0 if first is None else first + 1
    rows = []
    for s in specials:
        if s not in found:
            rows.append((s, next_id, True))
            next_id += 1
    flagged = base.select("token", "id", F.col("token").isin(*specials).alias("is_special"))
    if not rows:
        return flagged
    added = base.sparkSession.createDataFrame(rows, "token string, id int, is_special boolean")
    return flagged.unionByName(added)


def special_ids(vocabulary: DataFrame) -> DataFrame:
    """Sorted distinct ids of the special tokens, one row."""
    return vocabulary.where("is_special").agg(F.array_sort(F.collect_set("id")).alias("special_ids"))


def keep_special(long: DataFrame, vocabulary: DataFrame, *, keep: bool = True) -> DataFrame:
    """Token rows whose id is special (``keep``) or is not."""
    ids = vocabulary.where("is_special").select(F.col("id").alias("token"))
    return join_bounded(long, ids, ["token"], "left_semi" if keep else "left_anti")


def encode(words: DataFrame, vocabulary: DataFrame, unknown_id: int, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``id`` to word rows; words outside the vocabulary get ``unknown_id``, rows without a word null."""
    found = join_bounded(words, vocabulary.select("token", "id"), ["token"], "left", max_rows=max_rows)
    return found.withColumn("id", F.when(F.col("token").isNotNull(), F.coalesce("id", F.lit(unknown_id))))


def decode(docs: DataFrame, vocabulary: DataFrame, order: str = "doc_id", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Text of id arrays: words in order, joined by one blank; without ids the text is empty."""
    long = docs.select(order, F.posexplode_outer(F.filter("tokens", lambda t: t.isNotNull())).alias("pos", "id"))
    named = join_bounded(long, vocabulary.select("id", "token"), ["id"], "left", max_rows=max_rows)
    in_order = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token", F.lit("")).alias("token"))))
    return named.groupBy(order).agg(in_order.alias("__w")).select(
        order, F.array_join(F.col("__w.token"), " ").alias("text"))
