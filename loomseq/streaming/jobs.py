"""Streams over arriving documents and metric rows.

Order is that of the key inside a micro-batch and of arrival between batches;
results equal the batch operators for files that arrive in key order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import log_steps
from ..operators.ordered import cut_positions
from ..operators.sharding import tokenize
from ..sources.metric_sink import log_batch


def tokenize_stream(corpus: DataFrame, tokenizer: Column | None = None) -> DataFrame:
    """Stateless tokenising of arriving documents."""
    return tokenize(corpus, tokenizer)


def start_table(stream: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet table; ``once`` stops after all files present."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def _in_order(frames, *columns: str) -> pd.DataFrame:
    """All rows of one micro-batch group in key order."""
    return pd.concat(list(frames), ignore_index=True).sort_values(list(columns), kind="stable", ignore_index=True)


def cut_stream(lengths: DataFrame, target: int, lane: str = "lane") -> DataFrame:
    """Shard cut of arriving ``(lane, doc_id, len)`` rows.

    A lane is one writer with its own shard numbers. Its state is three numbers;
    keys and lengths of one micro-batch pass through, tokens do not.
    """

    def cut(key, frames, state):
        run, shard, doc_ix = state.get if state.exists else (0, 0, 0)
        rows = _in_order(frames, "doc_id")
        length = rows["len"].to_numpy()
        # The running shard acts as one more document in front.
        ends = cut_positions(np.concatenate(([run], length)), target) - 1
        number = np.searchsorted(ends, np.arange(len(length)), side="right")
        begins = np.concatenate(([0], ends))
        after = np.cumsum(length)
        before = after - length
        base = np.where(number > 0, before[np.minimum(begins[number], len(length) - 1)], -run)
        first = np.where(number > 0, begins[number], -doc_ix)
        out = pd.DataFrame({
            lane: key[0], "doc_id": rows["doc_id"], "shard_idx": shard + number,
            "doc_ix": np.arange(len(length)) - first, "start": before - base, "end": after - base})
        tail = int(begins[-1])
        if len(ends):
            state.update((int(after[-1] - (after[tail - 1] if tail else 0)), shard + len(ends), len(length) - tail))
        else:
            state.update((int(run + after[-1]), shard, doc_ix + len(length)))
        yield out

    return lengths.where(F.col("len") > 0).groupBy(lane).applyInPandasWithState(
        cut, f"{lane} int, doc_id bigint, shard_idx bigint, doc_ix bigint, start bigint, end bigint",
        "run bigint, shard_idx bigint, doc_ix bigint", "append", "NoTimeout")


def pack_stream(dealt: DataFrame, sequence_length: int, stride: int) -> DataFrame:
    """Sequence plan of arriving ``(rank, doc_id, len)`` rows.

    State is the open sequence of each rank (fewer than ``sequence_length``
    tokens, so as many documents at most) and its number. What stays open at the
    end of the input is not emitted.
    """

    def pack(key, frames, state):
        bin_, ids, lens = state.get if state.exists else (0, [], [])
        rows = _in_order(frames, "doc_id")
        doc = np.concatenate((np.asarray(ids, dtype=np.int64), rows["doc_id"].to_numpy()))
        length = np.concatenate((np.asarray(lens, dtype=np.int64), rows["len"].to_numpy()))
        ends = cut_positions(length, sequence_length)
        closed = int(ends[-1]) if len(ends) else 0
        state.update((bin_ + len(ends), doc[closed:].tolist(), length[closed:].tolist()))
        place = np.arange(closed)
        number = np.searchsorted(ends, place, side="right")
        first = np.concatenate(([0], ends))[number]
        used = length[:closed] + 2 + ((length[:closed] - 1) // stride if stride > 0 else 0)
        before = np.cumsum(used) - used
        yield pd.DataFrame({
            "rank": key[0], "bin": bin_ + number, "ord": place - first, "doc_id": doc[:closed],
            "len": length[:closed], "seq_start": before - before[first]})

    return dealt.where(F.col("len") > 0).groupBy("rank").applyInPandasWithState(
        pack, "rank int, bin bigint, ord int, doc_id bigint, len bigint, seq_start bigint",
        "bin bigint, doc_ids array<bigint>, lens array<bigint>", "append", "NoTimeout")


def start_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, *,
                  once: bool = True) -> StreamingQuery:
    """Hand every micro-batch to ``each``, e.g. to join a sequence plan to its tokens."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_metric_log(metrics: DataFrame, path: str, checkpoint: str, *, every: int, writer: str = "metrics",
                     once: bool = True) -> StreamingQuery:
    """Append arriving metric rows at logged steps to the metric table, every micro-batch once."""
    return start_batches(
        log_steps(metrics, every), lambda rows, batch_id: log_batch(rows, path, writer, batch_id), checkpoint, once=once)
