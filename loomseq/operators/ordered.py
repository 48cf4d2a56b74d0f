"""Order-dependent work without a single-task pass over the rows.

``prefix_sums``  running totals over an order key, in two levels.
``ordered_rank`` row numbers over a hashed (uniform) text key, in two levels.
``greedy_cut``   running sum that restarts when it reaches a target.

The greedy cut is a chain: a shard that starts at token coordinate ``c`` ends at
the first document end ``>= c + target``. Each block of rows is summarised,
independently of the others, as a step function *"enter here, leave after so
many cuts at that document end"*. Step functions compose, so a few blocks at a
time are folded, level by level, until a few are left. The states of the one
real chain travel back down, and every block then numbers its own documents. A
summary has at most as many steps as documents begin within one target, so one
fold takes ``FAN_IN`` times that, and a leaf ``BLOCK_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import first_hex_bucket, int_div
from ..session import materialise

#: order-key width of one bucket of the two-level running total
BUCKET_WIDTH = 65_536
#: rows of one leaf block of the greedy cut, and blocks folded into one of the next level
BLOCK_ROWS, FAN_IN = 65_536, 8


def _fixed_range(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width))


def key_ranges(df: DataFrame, order: str, width: int = BUCKET_WIDTH, out: str = "__range") -> DataFrame:
    """Add the number of the key range a row lies in; ranges follow the order of the key.

    Integer keys without large holes are cut every ``width`` keys, an expression
    only. Sparse keys, and keys of other types, go through Spark's range
    partitioner, which balances by rows; the result is written down so that the
    ranges cannot differ between two readers.
    """
    if df.schema[order].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        rows, low, high = df.agg(F.count(F.lit(1)), F.min(order), F.max(order)).first()
        if not rows or high - low < 8 * max(rows, width):
            return df.withColumn(out, _fixed_range(order, width))
    ranged = df.repartitionByRange(order).withColumn(out, F.spark_partition_id().cast("bigint"))
    return materialise(ranged)


def prefix_sums(
    df: DataFrame,
    order: str,
    sums: dict[str, str],
    *,
    by: Sequence[str] = (),
    tie: Sequence[str] = (),
    width: int = BUCKET_WIDTH,
    dense: bool = False,
) -> DataFrame:
    """Add exclusive running totals over ``order`` within ``by``.

    ``sums`` maps new column -> summed column; a summed column of ``"*"`` counts
    rows. Totals of key ranges are added up first (one row per range), then each
    range is completed on its own; the join and the window share one shuffle.
    ``dense`` says that the keys are known to be consecutive integers, which
    saves looking. ``df`` is read several times; materialise it unless it is a
    cheap scan.
    """
    bucket = "__range"
    keys = [*by, bucket]
    rows = df.withColumn(bucket, _fixed_range(order, width)) if dense else key_ranges(df, order, width, bucket)
    value = {new: (F.lit(1).cast("bigint") if old == "*" else F.col(old).cast("bigint")) for new, old in sums.items()}

    totals = rows.groupBy(*keys).agg(*[F.sum(v).alias(f"__t_{new}") for new, v in value.items()])
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(f"__t_{new}").over(before), F.lit(0)).alias(f"__o_{new}") for new in sums])

    inside = Window.partitionBy(*keys).orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, -1)
    local = {
        new: F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"__o_{new}") for new, v in value.items()
    }
    return (
        rows.join(offsets, keys)
        .select(*[F.col(c) for c in df.columns], *[v.alias(new) for new, v in local.items()])
    )


def ordered_rank(df: DataFrame, key: str, out: str, *, by: Sequence[str] = (), tie: Sequence[str] = (),
                 digits: int = 3) -> DataFrame:
    """0-based row number of ``key`` (a hex hash) within ``by``.

    The first hex digits split the rows into equal, order-preserving buckets, so
    a group of any size is ranked by many tasks.
    """
    bucket = "__hash_bucket"
    keys = [*by, bucket]
    rows = df.withColumn(bucket, first_hex_bucket(F.col(key), digits))
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(*keys).orderBy(key, *tie)
    rank = (F.row_number().over(inside) - 1 + F.col("__o")).cast("bigint")
    return rows.join(offsets, keys).select(*[F.col(c) for c in df.columns], rank.alias(out))


# --- greedy cut -------------------------------------------------------------------------------

def cut_positions(lengths: np.ndarray, target: int) -> np.ndarray:
    """End index (exclusive) of every closed bin of one ordered group of lengths.

    One binary search per bin over the running total.
    """
    total = np.cumsum(lengths, dtype=np.int64)
    ends: list[int] = []
    base = 0
    while True:
        end = int(np.searchsorted(total, base + target)) + 1
        if end > len(total):
            return np.asarray(ends, dtype=np.int64)
        ends.append(end)
        base = int(total[end - 1])


def _successors(hi: np.ndarray, last: np.ndarray, target: int) -> np.ndarray:
    """For every node the node that holds the next cut (``len(hi)`` if it lies beyond)."""
    return np.searchsorted(hi, last + target)


def _summarise(hi, last, last_rn, cuts, start: int, target: int):
    """Fold the ordered nodes of one block into its step function.

    A chain enters the block below ``start + target``, so only nodes up to the
    first one at or past that coordinate can be hit first. Each of them is
    followed to the end of the block; neighbours with equal outcome are merged.
    """
    size = len(hi)
    entries = min(int(np.searchsorted(hi, start + target)) + 1, size)
    follow = _successors(hi, last, target)
    at = np.arange(entries)
    count = cuts[:entries].copy()
    while True:
        ahead = follow[at]
        live = ahead < size
        if not live.any():
            break
        at = np.where(live, ahead, at)
        count = count + np.where(live, cuts[at], 0)
    differs = (at[1:] != at[:-1]) | (count[1:] != count[:-1])
    keep = np.append(np.flatnonzero(differs), entries - 1)
    return hi[:entries][keep], last[at[keep]], last_rn[at[keep]], count[keep]


def _walk(hi, last, last_rn, cuts, base: int, base_rn: int, count: int, target: int):
    """Follow the one real chain through ordered nodes.

    Returns the visited node numbers and the states ``(base, base_rn, count)``
    before the first and after every visited node.
    """
    visited, states = [], [(base, base_rn, count)]
    size = len(hi)
    while True:
        node = int(np.searchsorted(hi, base + target))
        if node >= size:
            return np.asarray(visited, dtype=np.int64), np.asarray(states, dtype=np.int64).reshape(-1, 3)
        base, base_rn, count = int(last[node]), int(last_rn[node]), count + int(cuts[node])
        visited.append(node)
        states.append((base, base_rn, count))


def _columns(table: pa.Table, names: Sequence[str], order: str) -> list[np.ndarray]:
    cols = [table.column(n).to_numpy() for n in names]
    by = np.argsort(table.column(order).to_numpy(), kind="stable")
    return [c[by] for c in cols]


_NODE = "first bigint, hi bigint, last bigint, last_rn bigint, cuts bigint"
_STATE = "base bigint, base_rn bigint, count bigint"
_NODE_COLS = ("hi", "last", "last_rn", "cuts")


def _summary(block: int, first: int, nodes) -> pa.Table:
    """Rows of ``_NODE``; ``first`` is where the block begins."""
    hi, last, last_rn, cuts = nodes
    return pa.table({"block": np.full(len(hi), block), "first": np.full(len(hi), first), "hi": hi, "last": last,
                     "last_rn": last_rn, "cuts": cuts})


def _fold(nodes: DataFrame, fan_in: int, target: int) -> DataFrame:
    """Nodes of the next level, made from those of ``fan_in`` neighbouring blocks."""

    def fold(key, table):
        first, *cols = _columns(table, ("first", *_NODE_COLS), "hi")
        start = int(first.min())
        return _summary(key[0].as_py(), start, _summarise(*cols, start, target))

    parents = nodes.withColumn("parent", int_div(F.col("block"), fan_in))
    return parents.groupBy("parent").applyInArrow(fold, f"block bigint, {_NODE}")


def _states_for(blocks: np.ndarray, visited: np.ndarray, states: np.ndarray):
    """Chain state on arrival at each distinct block of the ordered nodes."""
    distinct = np.unique(blocks)
    return distinct, states[np.searchsorted(blocks[visited], distinct, side="left")]


def greedy_cut(
    docs: DataFrame,
    target: int,
    *,
    order: str = "doc_id",
    start: str = "start",
    length: str = "len",
    row: str = "rn",
    block_rows: int = BLOCK_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Cut ordered rows into bins that close at the row where their sum reaches ``target``.

    ``docs`` has the exclusive running total ``start``, the positive ``length``
    and the 0-based row number ``row`` (see :func:`prefix_sums`). The result has
    ``order``, ``bin`` (0-based), ``ix`` (0-based row in the bin), ``start`` and
    ``end`` (offsets in the bin). The open bin at the end keeps its own number.
    ``docs`` is read twice; materialise it first.
    """
    if target <= 0:
        raise ValueError("target must be > 0")
    leaves = docs.select(
        F.col(order).cast("bigint").alias("ord"),
        (F.col(start) + F.col(length)).cast("bigint").alias("hi"),
        F.col(length).cast("bigint").alias("len"),
        F.col(row).cast("bigint").alias("rn"),
    ).withColumn("block", int_div(F.col("rn"), block_rows))

    def fold_leaves(key, table):
        hi, rn, size = _columns(table, ("hi", "rn", "len"), "hi")
        begin = int(hi[0] - size[0])
        return _summary(key[0].as_py(), begin, _summarise(hi, hi, rn, np.ones(len(hi), dtype=np.int64), begin, target))

    levels = [materialise(leaves.groupBy("block").applyInArrow(fold_leaves, f"block bigint, {_NODE}"))]
    blocks = (levels[0].agg(F.max("block")).first()[0] or 0) + 1
    while blocks > fan_in:
        levels.append(materialise(_fold(levels[-1], fan_in, target)))
        blocks = -(-blocks // fan_in)

    def walked(table, entry):
        ids, *cols = _columns(table, ("block", *_NODE_COLS), "hi")
        visited, states = _walk(*cols, *entry, target)
        distinct, state = _states_for(ids, visited, states)
        return pa.table({"block": distinct, "base": state[:, 0], "base_rn": state[:, 1], "count": state[:, 2]})

    top = levels.pop().withColumn("chain", F.lit(0)).groupBy("chain")
    block_states = top.applyInArrow(lambda table: walked(table, (0, -1, 0)), f"block bigint, {_STATE}")

    def walk_below(left, right):
        return walked(left, (right.column(c)[0].as_py() for c in ("base", "base_rn", "count")))

    while levels:
        below = levels.pop().withColumn("parent", int_div(F.col("block"), fan_in))
        block_states = below.groupBy("parent").cogroup(block_states.groupBy("block")).applyInArrow(
            walk_below, f"block bigint, {_STATE}")

    def number(left, right):
        ids, hi, length_, rn = _columns(left, ("ord", "hi", "len", "rn"), "hi")
        entry = tuple(right.column(c)[0].as_py() for c in ("base", "base_rn", "count"))
        visited, states = _walk(hi, hi, rn, np.ones(len(hi), dtype=np.int64), *entry, target)
        state = states[np.searchsorted(visited, np.arange(len(hi)), side="left")]
        return pa.table({
            order: ids,
            "bin": state[:, 2],
            "ix": rn - state[:, 1] - 1,
            "start": hi - length_ - state[:, 0],
            "end": hi - state[:, 0],
        })

    return leaves.groupBy("block").cogroup(block_states.groupBy("block")).applyInArrow(
        number, f"{order} bigint, bin bigint, ix bigint, start bigint, end bigint")
