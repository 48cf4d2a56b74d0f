"""Shards to fixed-length sequences, for all ranks and epochs in one plan.

Everything up to :func:`fetch_plan` handles lengths only. Tokens are joined last,
cut to what can still appear in a sequence, and grouped once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numeric as N
from ..functions.markers import count_id, wrap_document
from ..session import spread_by
from .ordered import cut_positions, ordered_rank, prefix_sums


def check_parameters(sequence_length: int, world_size: int, rank: int | None = None) -> None:
    if sequence_length <= 0:
        raise ValueError(f"cannot pack into sequences of {sequence_length} tokens")
    if world_size <= 0:
        raise ValueError(f"cannot deal documents to {world_size} ranks")
    if rank is not None and not 0 <= rank < world_size:
        raise ValueError(f"there is no rank {rank} among {world_size}")


def repeat_epochs(df: DataFrame, epochs: int) -> DataFrame:
    """Every row once per epoch (index rows, never tokens)."""
    return df.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))


def epoch_shard_order(doc_index: DataFrame, epochs: int, base_seed: int) -> DataFrame:
    """``(epoch, shard_idx, place)``: the seeded order in which an epoch visits the shards."""
    shards = repeat_epochs(doc_index.select("shard_idx").distinct(), epochs)
    keyed = shards.withColumn("__key", N.shuffle_key(N.epoch_seed(base_seed, F.col("epoch")), F.col("shard_idx")))
    return ordered_rank(keyed, "__key", "place", by=["epoch"], tie=["shard_idx"]).select("epoch", "shard_idx", "place")


def deal_documents(doc_index: DataFrame, *, epochs: int, world_size: int, base_seed: int) -> DataFrame:
    """Shuffle the documents of every shard and deal them to ranks in turn.

    ``turn`` counts all documents of the shard, empty ones too; a shard is the
    largest group any task sees.
    """
    order = epoch_shard_order(doc_index, epochs, base_seed)
    keyed = repeat_epochs(doc_index, epochs).join(order, ["epoch", "shard_idx"]).withColumn(
        "__key", N.shuffle_key(N.document_seed(base_seed, F.col("epoch"), F.col("place")), F.col("doc_ix")))
    turn = F.row_number().over(Window.partitionBy("epoch", "shard_idx").orderBy("__key", "doc_ix")) - 1
    return keyed.withColumn("turn", turn).withColumn("rank", F.col("turn") % world_size).drop("__key")


def pick_rank(dealt: DataFrame, rank: int) -> DataFrame:
    """Documents of one rank."""
    return dealt.where(F.col("rank") == rank)


_BINS = ("epoch int, shard_idx bigint, place bigint, rank int, bin bigint, ord int, "
         "doc_id bigint, doc_ix bigint, len bigint, seq_start bigint")
_BINS_ARROW = pa.schema([
    ("epoch", pa.int32()), ("shard_idx", pa.int64()), ("place", pa.int64()), ("rank", pa.int32()),
    ("bin", pa.int64()), ("ord", pa.int32()), ("doc_id", pa.int64()), ("doc_ix", pa.int64()),
    ("len", pa.int64()), ("seq_start", pa.int64()),
])


def _close_bins(rows: dict[str, np.ndarray], state: tuple | None, sequence_length: int, stride: int):
    """Closed bins of consecutive groups, the rows of the last open bin, the new state.

    ``state`` is the last group seen and its next bin number; a group that goes
    on continues there, every other group starts at bin 0.
    """
    size = len(rows["len"])
    change = np.zeros(size, dtype=bool)
    for c in ("epoch", "shard_idx", "rank"):
        change[1:] |= rows[c][1:] != rows[c][:-1]
    starts = np.concatenate(([0], np.flatnonzero(change), [size]))
    picked, bins, firsts = [], [], []
    open_from = size
    for lo, hi in zip(starts[:-1], starts[1:]):
        ends = cut_positions(rows["len"][lo:hi], sequence_length)
        group = tuple(int(rows[c][lo]) for c in ("epoch", "shard_idx", "rank"))
        base = state[1] if state is not None and state[0] == group else 0
        closed = int(ends[-1]) if len(ends) else 0
        if closed:
            which = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            picked.append(np.arange(lo, lo + closed))
            bins.append(which + base)
            firsts.append(lo + np.concatenate(([0], ends[:-1]))[which])
        open_from, state = lo + closed, (group, base + len(ends))
    carry = {c: v[open_from:] for c, v in rows.items()}
    pick = np.concatenate(picked) if picked else np.empty(0, dtype=np.int64)
    first = np.concatenate(firsts) if firsts else pick
    used = rows["len"] + 2 + ((rows["len"] - 1) // stride if stride > 0 else 0)
    before = np.cumsum(used) - used
    done = {c: rows[c][pick] for c in ("epoch", "shard_idx", "place", "rank", "doc_id", "doc_ix", "len")}
    done["bin"] = np.concatenate(bins) if bins else pick
    done["ord"] = pick - first
    done["seq_start"] = before[pick] - before[first]
    return done, carry, state


def pack_bins(dealt: DataFrame, *, sequence_length: int, stride: int) -> DataFrame:
    """Close a sequence whenever a rank's raw lengths in a shard reach ``sequence_length``.

    One row per document of a closed sequence with its place ``ord`` and the
    offset ``seq_start`` at which its bos lands. The open rest of every
    (epoch, shard, rank) is dropped, empty documents are dropped after dealing.
    """

    names = ("epoch", "shard_idx", "place", "rank", "doc_id", "doc_ix", "len")

    def pack(batches):
        # Rows arrive ordered by (epoch, shard, rank, turn). Only the documents of
        # the one sequence still open are carried from batch to batch.
        carry = state = None
        for batch in batches:
            rows = {c: batch.column(c).to_numpy() for c in names}
            if carry is not None:
                rows = {c: np.concatenate((carry[c], v)) for c, v in rows.items()}
            if not len(rows["len"]):
                continue
            done, carry, state = _close_bins(rows, state, sequence_length, stride)
            if len(done["len"]):
                yield pa.RecordBatch.from_pydict(done, schema=_BINS_ARROW)

    slim = dealt.select("epoch", "shard_idx", "place", "rank", "turn", "doc_id", "doc_ix",
                        (F.col("end") - F.col("start")).alias("len"))
    # The rows of a rank's shard must meet in one task, whatever layout the input has.
    placed = slim.where(F.col("len") > 0).repartition("epoch", "shard_idx", "rank")
    ordered = placed.sortWithinPartitions("epoch", "shard_idx", "rank", "turn")
    return ordered.select(*names).mapInArrow(pack, _BINS)


def number_sequences(bins: DataFrame) -> DataFrame:
    """``seq_ix``: the order in which a rank's sequences close over an epoch.

    Sequences per shard are counted first and summed over the shard places in
    two levels; nothing ranks all sequences in one task. ``bins`` is read several
    times; materialise it first.
    """
    keys = ["epoch", "rank", "place", "shard_idx"]
    per_shard = bins.where(F.col("ord") == 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    offsets = prefix_sums(per_shard, "place", {"__before": "__n"}, by=["epoch", "rank"], width=1_024, dense=True)
    return bins.join(offsets.drop("__n"), keys).withColumn("seq_ix", F.col("__before") + F.col("bin")).drop("__before")


def _raw_kept(length: Column, seq_start: Column, sequence_length: int, stride: int) -> Column:
    """Raw tokens of a document that survive the cut, from lengths alone."""
    room = F.greatest(F.lit(sequence_length) - seq_start - 1, F.lit(0))
    raw = room - N.int_div(room, stride + 1) if stride > 0 else room
    return F.least(length, raw)


def fetch_plan(bins: DataFrame, sequence_length: int) -> DataFrame:
    """Documents whose tokens can still appear in their sequence."""
    return bins.where(F.col("seq_start") < sequence_length)


def packing_loss(bins: DataFrame, *, sequence_length: int, stride: int) -> DataFrame:
    """Per sequence: raw tokens taken, kept and cut, documents taken and lost entirely."""
    kept = _raw_kept(F.col("len"), F.col("seq_start"), sequence_length, stride)
    return bins.groupBy("epoch", "shard_idx", "rank", "bin").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("len").alias("raw_taken"),
        F.sum(kept).alias("raw_kept"),
        F.sum(F.col("len") - kept).alias("raw_cut"),
        F.count_if(kept == 0).alias("documents_lost"),
    )


def packing_rest(dealt: DataFrame, bins: DataFrame) -> DataFrame:
    """Per (epoch, shard_idx, rank): documents and raw tokens dealt, and those left in its open sequence, which is dropped."""
    keys = ["epoch", "shard_idx", "rank"]
    length = F.col("end") - F.col("start")
    given = dealt.where(length > 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("documents"), F.sum(length).alias("tokens"))
    used = bins.groupBy(*keys).agg(F.count(F.lit(1)).alias("d"), F.sum("len").alias("t"))
    return given.join(used, keys, "left").select(
        *keys, "documents", "tokens", (F.col("documents") - F.coalesce("d", F.lit(0))).alias("documents_open"),
        (F.col("tokens") - F.coalesce("t", F.lit(0))).alias("tokens_open"))


def build_sequences(
    bins: DataFrame, docs: DataFrame, *, sequence_length: int, stride: int, marker_id: int, bos_id: int, pad_id: int
) -> DataFrame:
    """Token arrays of all packed sequences.

    Documents are cut to ``sequence_length`` raw tokens before the join: no later
    token can survive, so one very long document costs no more than others there.
    The join is a merge join whatever the sizes look like: the token side grows
    with the corpus and is never broadcast.
    """
    head = docs.select("doc_id", F.slice("tokens", 1, sequence_length).alias("__head")).hint("merge")
    plan = fetch_plan(bins, sequence_length).drop("doc_ix", "len", "seq_start", "place")
    wrapped = plan.join(head, "doc_id").withColumn(
        "__doc", wrap_document(F.col("__head"), stride, marker_id, bos_id, pad_id))
    keys = [c for c in ("epoch", "shard_idx", "rank", "bin", "seq_ix") if c in bins.columns]
    ordered = F.array_sort(F.collect_list(F.struct("ord", "__doc")))
    # Hashed on the sequence before grouping: pre-aggregation on the sending side would
    # find nothing to merge, the documents of a sequence hardly ever meet there.
    return (
        spread_by(wrapped, *keys).groupBy(*keys).agg(ordered.alias("__parts"))
        .select(*keys, F.slice(F.flatten(F.col("__parts.__doc")), 1, sequence_length).alias("tokens"))
    )


def pad_counts(packed: DataFrame, pad_id: int) -> DataFrame:
    """Pads per sequence and whether there is any."""
    pads = count_id(F.col("tokens"), pad_id)
    return packed.withColumn("pads", pads).withColumn("has_pads", F.col("pads") > 0)
