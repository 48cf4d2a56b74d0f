"""Packing of arriving documents into token sequences, with an end for sequences that stay open.

The state of one (epoch, shard, rank) is its open sequence: keys and lengths of
fewer than ``sequence_length`` tokens. A timer per group follows the event time. When the
watermark passes it, the open rest comes out, marked as such; when a second one
passes, the group's number is forgotten too, so that finished groups leave no state.
Tokens are joined to the plan batch by batch, and never enter the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.ordered import cut_positions
from ..operators.packing import build_sequences, fetch_plan
from ..schemas import SEQUENCES, STREAM_PLAN
from ..sources.batch_ledger import append_batch, read_batch, read_batches
from .jobs import start_batches

KEY = ("epoch", "shard_idx", "rank")
_STORE = "spark.sql.streaming.stateStore.providerClass"


class OpenSequences(StatefulProcessor):
    """The open sequence of a group, closed by length or, in the end, by time."""

    def __init__(self, sequence_length: int, stride: int, timeout_ms: int, forget_ms: int):
        self.sequence_length, self.stride = sequence_length, stride
        self.timeout_ms, self.forget_ms = timeout_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "bin bigint, due bigint")
        self.open = handle.getListState("open", "doc_id bigint, len bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # rows as they are: a group has few, and frames of so few cost more than the work
        new = sorted((r for r in rows if r.len is not None and r.len > 0), key=lambda r: (r.turn is None, r.turn or 0))
        if not new:
            return
        bin_, due = self.group.get() if self.group.exists() else (0, None)
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        docs = held + [(r.doc_id, r.len) for r in new]
        ends = cut_positions(np.array([n for _, n in docs], dtype=np.int64), self.sequence_length)
        closed = int(ends[-1]) if len(ends) else 0
        if closed < len(docs):
            self.open.put(docs[closed:])
        elif held:
            self.open.clear()
        until = max(r.arrived_ms for r in new) + self.timeout_ms
        self._wait(bin_ + len(ends), due, max(until, due) if held else until)
        yield from self._rows(key, bin_, docs, ends.tolist(), True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        bin_, due = self.group.get()
        if self.open.exists():
            held = [tuple(r) for r in self.open.get()]
            self.open.clear()
            yield from self._rows(key, bin_, held, [len(held)], False)
            # a document that still comes starts the next sequence
            self._wait(bin_ + 1, None, due + self.forget_ms)
        elif expiredTimerInfo.getExpiryTimeInMs() >= due:
            self.group.clear()

    def close(self) -> None:
        pass

    def _wait(self, bin_: int, due: int | None, until: int) -> None:
        """Remember the next sequence number and wait for the watermark; a group has one timer."""
        if due is not None and due != until:
            self.handle.deleteTimer(due)
        self.handle.registerTimer(until)
        self.group.update((bin_, until))

    def _rows(self, key, bin_: int, docs: list[tuple], ends: list[int], closed: bool) -> Iterator[Row]:
        """The documents (doc_id, len) of the sequences that end before ``ends``, numbered from ``bin_``."""
        begin = 0
        for number, end in enumerate(ends, bin_):
            before = 0
            for ord_, (doc_id, length) in enumerate(docs[begin:end]):
                yield Row(**dict(zip(KEY, key)), bin=number, ord=ord_, doc_id=doc_id, len=length, seq_start=before, closed=closed)
                before += length + 2 + ((length - 1) // self.stride if self.stride > 0 else 0)
            begin = end


def pack_stream_until(
    dealt: DataFrame, *, sequence_length: int, stride: int, timeout: str, delay: str = "30 seconds", forget: str = "1 day",
) -> DataFrame:
    """Sequence plan of arriving ``(epoch, shard_idx, rank, turn, doc_id, len, arrived)`` rows.

    Documents of a group arrive in order of ``turn``; within a batch they are
    sorted. ``closed`` tells full sequences from rests that came out because no
    document of the group had arrived for ``timeout`` of event time. ``delay`` is the
    watermark's. ``forget`` later the group's number is dropped.
    """
    ms = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    processor = OpenSequences(sequence_length, stride, ms(timeout), ms(forget))
    slim = dealt.select(*KEY, "turn", "doc_id", "len", "arrived", F.unix_millis("arrived").alias("arrived_ms")).withWatermark("arrived", delay)
    return slim.groupBy(*KEY).transformWithState(
        processor, outputStructType=STREAM_PLAN, outputMode="append", timeMode="EventTime")


def start_sequences(
    plan: DataFrame, docs: DataFrame, path: str, checkpoint: str, *, sequence_length: int, stride: int, marker_id: int, bos_id: int,
    pad_id: int, writer: str = "packing", once: bool = True,
) -> StreamingQuery:
    """Write a stream's plan and its sequences, every batch once.

    ``docs`` (doc_id, tokens) holds the tokens of all documents a plan can name. A
    batch reads the range of ids its plan names, which row-group statistics cut out
    of a table written in order of arrival.
    """
    spark = plan.sparkSession

    def each(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        if not append_batch(rows, f"{path}/plan", writer, batch_id):
            rows.write.format("noop").mode("overwrite").save()  # a replay must bring the state on all the same
        # from the table: a replayed batch goes on with the rows that were entered
        bins = fetch_plan(read_batch(session, f"{path}/plan", STREAM_PLAN, writer, batch_id).where("closed"), sequence_length)
        low, high = bins.agg(F.min("doc_id"), F.max("doc_id")).first()
        if low is not None:
            some = docs.where(F.col("doc_id").between(low, high))
            built = build_sequences(bins, some, sequence_length=sequence_length, stride=stride,
                                    marker_id=marker_id, bos_id=bos_id, pad_id=pad_id)
            append_batch(built.select(*SEQUENCES.names), f"{path}/sequences", writer, batch_id)

    before = spark.conf.get(_STORE)
    # timers and lists of a group need this store; a query keeps the one it began with
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return start_batches(plan, each, checkpoint, once=once)
    finally:
        spark.conf.set(_STORE, before)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """The whole plan so far: closed sequences, and rests that came out."""
    return read_batches(spark, f"{path}/plan", STREAM_PLAN)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Token arrays of the closed sequences so far."""
    return read_batches(spark, f"{path}/sequences", SEQUENCES)


def open_rests(plan: DataFrame) -> DataFrame:
    """Per group: documents and raw tokens that arrived, and those of its rests that came out open."""
    open_ = ~F.col("closed")
    return plan.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("len").alias("tokens"), F.count_if(open_).alias("documents_open"),
        F.coalesce(F.sum(F.when(open_, F.col("len"))), F.lit(0)).alias("tokens_open"))
