"""The three jobs: corpus to shards, shards to sequences, multiple-choice report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import words as W
from ..operators import evaluation as E
from ..operators import packing as P
from ..operators import sharding as S
from ..session import materialise


@dataclass(frozen=True)
class SequenceSettings:
    """Parameters of sharding and packing; the defaults are the usual training sizes."""

    tokens_per_shard: int = 16 * 1024 * 32
    sequence_length: int = 16 * 1024
    stride: int = 7
    world_size: int = 1
    epochs: int = 1
    base_seed: int = 42
    marker_id: int = W.MARKER_ID
    pad_id: int = W.PAD_ID
    bos_id: int = W.BOS_ID

    def __post_init__(self) -> None:
        P.check_parameters(self.sequence_length, self.world_size)


def index_corpus(
    corpus: DataFrame, settings: SequenceSettings, *, max_samples: int | None = None, max_tokens: int | None = None,
    lengths: DataFrame | None = None, tokenizer: Column | None = None,
) -> DataFrame:
    """Document index of the shards of a corpus.

    Counting needs one scan and moves no text. ``lengths`` may hand in known token
    counts. Without them a custom tokenizer runs for its lengths alone; write its
    output first when it is expensive.
    """
    corpus = S.cap_samples(corpus, max_samples)
    if lengths is None:
        lengths = S.word_lengths(corpus) if tokenizer is None else S.token_lengths(S.tokenize(corpus, tokenizer))
    return S.assign_shards(lengths, settings.tokens_per_shard, max_tokens=max_tokens)


def plan_bins(doc_index: DataFrame, settings: SequenceSettings) -> DataFrame:
    """Which documents go into which sequence, for all epochs and ranks; lengths only, written down."""
    dealt = P.deal_documents(
        doc_index, epochs=settings.epochs, world_size=settings.world_size, base_seed=settings.base_seed)
    return materialise(P.pack_bins(dealt, sequence_length=settings.sequence_length, stride=settings.stride))


def pack_corpus(corpus: DataFrame, settings: SequenceSettings, doc_index: DataFrame | None = None) -> DataFrame:
    """Packed sequences of a corpus with the word tokenizer; tokens are moved twice in all."""
    doc_index = index_corpus(corpus, settings) if doc_index is None else doc_index
    return sequences(plan_bins(doc_index, settings), S.tokenize(S.spread(corpus)), settings)


def sequences(bins: DataFrame, docs: DataFrame, settings: SequenceSettings) -> DataFrame:
    return P.build_sequences(
        bins, docs, sequence_length=settings.sequence_length, stride=settings.stride,
        marker_id=settings.marker_id, bos_id=settings.bos_id, pad_id=settings.pad_id)


def pack_shards(rows: DataFrame, index: DataFrame, settings: SequenceSettings) -> DataFrame:
    """Packed sequences of written shards, Parquet or raw.

    ``index`` (shard_idx, documents) alone decides who goes where; ``rows``
    (shard_idx, doc_ix, tokens) are read once. Ids are checked to fit 31 bits.
    """
    doc_index = materialise(S.index_documents(index))
    checked = S.check_ids(rows.select("shard_idx", "doc_ix", "tokens"))
    docs = checked.select(
        S.shard_document_id(F.col("shard_idx"), F.col("doc_ix")).alias("doc_id"),
        F.col("tokens").cast("array<int>").alias("tokens"))
    return sequences(plan_bins(doc_index, settings), docs, settings)


def multiple_choice_report(
    items: DataFrame, logp: DataFrame, subjects: Sequence[str], *, max_items: int | None = None, value: str = "logp",
) -> DataFrame:
    """Accuracy per wanted subject and overall from a table of token log-probabilities."""
    wanted = items.where(F.col("subject").isin(list(subjects)))
    return E.subject_accuracy(E.graded_items(wanted, logp, max_items=max_items, value=value), subjects)
