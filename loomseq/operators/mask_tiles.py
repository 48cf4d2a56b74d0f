"""Tiles of any attention mask, most of them decided by a zone map.

A mask is a function ``mask(q, k)`` of a query and a key position, written with
comparisons, ``+ -``, ``& | ~``. It is first asked about whole blocks: fields are
then ranges, and the answer says whether a tile may hold a true cell and whether
all of its cells must be true. Only tiles that are neither empty nor full for
certain are asked cell by cell. The same function, with columns for fields, goes
through :func:`loomseq.functions.structure.allowed_keys`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .structure import SEQUENCE_KEY

FIELDS = ("pos", "token", "doc", "group", "is_marker", "is_pad")


class Answer:
    """What a condition says about all pairs of a tile: true for some at most (``may``), true for all (``must``)."""

    def __init__(self, may, must):
        self.may, self.must = may, must

    def __and__(self, other):
        other = _answer(other)
        return Answer(self.may & other.may, self.must & other.must)

    def __or__(self, other):
        other = _answer(other)
        return Answer(self.may | other.may, self.must | other.must)

    def __invert__(self):
        return Answer(~self.must, ~self.may)

    __rand__, __ror__ = __and__, __or__

    def __bool__(self):
        raise TypeError("write masks with & | ~")


class Range:
    """Least and greatest value of a field in the blocks of a tile."""

    def __init__(self, low, high):
        self.low, self.high = low, high

    def __add__(self, other):
        other = _range(other)
        return Range(self.low + other.low, self.high + other.high)

    def __neg__(self):
        return Range(-self.high, -self.low)

    def __sub__(self, other):
        return self + -_range(other)

    def __rsub__(self, other):
        return _range(other) + -self

    __radd__ = __add__

    def __le__(self, other):
        other = _range(other)
        return Answer(self.low <= other.high, self.high <= other.low)

    def __lt__(self, other):
        other = _range(other)
        return Answer(self.low < other.high, self.high < other.low)

    def __ge__(self, other):
        return _range(other) <= self

    def __gt__(self, other):
        return _range(other) < self

    def __eq__(self, other):
        other = _range(other)
        meet = (self.low <= other.high) & (other.low <= self.high)
        return Answer(meet, (self.low == self.high) & (other.low == other.high) & (self.low == other.low))

    def __ne__(self, other):
        return ~(self == other)

    __hash__ = None

    def __bool__(self):
        raise TypeError("write masks with & | ~")


def _range(value) -> Range:
    return value if isinstance(value, Range) else Range(np.int64(value), np.int64(value))


def _answer(value) -> Answer:
    return value if isinstance(value, Answer) else Answer(np.bool_(value), np.bool_(value))


def position_fields(tokens: np.ndarray, marker_id: int, pad_id: int | None) -> dict[str, np.ndarray]:
    """Fields of every position of a sequence."""
    pad = np.zeros(len(tokens), dtype=bool) if pad_id is None else tokens == pad_id
    mark = tokens == marker_id
    return {"pos": np.arange(len(tokens)), "token": tokens.astype(np.int64), "doc": np.cumsum(pad) - pad,
            "group": np.cumsum(mark) - mark, "is_marker": mark, "is_pad": pad}


def zone_map(fields: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Least and greatest value of each field in every block."""
    return {n: (np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)) for n, v in fields.items()}


def _side(zones, shape) -> dict[str, Range | Answer]:
    # a flag that is true somewhere may hold, one that is true everywhere must
    return {n: Answer(high.reshape(shape), low.reshape(shape)) if low.dtype == bool else Range(low.reshape(shape), high.reshape(shape))
            for n, (low, high) in zones.items()}


def sequence_tiles(tokens: np.ndarray, mask: Callable, block: int, marker_id: int, pad_id: int | None):
    """``(q_block, k_block, cells, full, tested)`` of the tiles with a true cell, and the numbers of skipped and tested tiles."""
    fields = position_fields(tokens, marker_id, pad_id)
    starts = np.arange(0, len(tokens), block)
    size = np.diff(np.append(starts, len(tokens)))
    zones = zone_map(fields, starts)
    answer = _answer(mask(_side(zones, (-1, 1)), _side(zones, (1, -1))))
    shape = (len(starts), len(starts))
    may, must = np.broadcast_to(answer.may, shape), np.broadcast_to(answer.must, shape)
    cells = np.where(must, size[:, None] * size, 0)
    test = may & ~must
    for q in np.flatnonzero(test.any(axis=1)):
        k = np.flatnonzero(test[q])
        keys = np.concatenate([np.arange(starts[b], starts[b] + size[b]) for b in k])
        rows = slice(starts[q], starts[q] + size[q])
        true = mask({n: v[rows, None] for n, v in fields.items()}, {n: v[keys][None, :] for n, v in fields.items()})
        true = np.broadcast_to(true, (size[q], len(keys)))
        cells[q, k] = np.add.reduceat(true.sum(axis=0), np.cumsum(size[k]) - size[k])
    q, k = np.nonzero(cells)
    return (q, k, cells[q, k], cells[q, k] == size[q] * size[k], test[q, k]), int((~may).sum()), int(test.sum())


_TILE = pa.struct([("q_block", pa.int64()), ("k_block", pa.int64()), ("cells", pa.int64()), ("full", pa.bool_())])


def with_tiles(packed: DataFrame, mask: Callable, *, marker_id: int, pad_id: int | None, block: int = 128,
               key: Sequence[str] = SEQUENCE_KEY) -> DataFrame:
    """One row per sequence of ``packed`` (key, tokens): its tiles under ``mask`` and how they were decided.

    ``tiles`` lists (q_block, k_block, cells, full) of the tiles with a true cell. Of
    all ``n_tiles``, ``skipped`` hold none by the zone map, ``filled`` are full by it, ``tested``
    were asked cell by cell. Work and memory are those of one sequence at a time, and
    no pair leaves the row. An empty sequence has no tile.
    """
    key = list(key)
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    out = [*key, "tiles", "n_tiles", "skipped", "filled", "tested"]

    def run(batches):
        for batch in batches:
            arrays = batch.column("tokens")
            flat, offsets = arrays.values.to_numpy(zero_copy_only=False), arrays.offsets.to_numpy()
            tiles, counts = [], []
            for lo, hi in zip(offsets[:-1], offsets[1:]):
                if lo == hi:
                    tiles.append([])
                    counts.append((0, 0, 0, 0))
                    continue
                (q, k, cells, full, _), skipped, tested = sequence_tiles(flat[lo:hi], mask, block, marker_id, pad_id)
                all_ = (-(-int(hi - lo) // block)) ** 2
                tiles.append(pa.StructArray.from_arrays(
                    [pa.array(q, pa.int64()), pa.array(k, pa.int64()), pa.array(cells, pa.int64()), pa.array(full)], fields=list(_TILE)))
                counts.append((all_, skipped, all_ - skipped - tested, tested))
            ends = np.cumsum([0, *map(len, tiles)]).astype(np.int32)
            held = [t for t in tiles if len(t)]
            values = pa.concat_arrays(held) if held else pa.array([], _TILE)
            columns = [pa.array(c, pa.int64()) for c in np.array(counts, dtype=np.int64).reshape(-1, 4).T]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in key), pa.ListArray.from_arrays(ends, values), *columns], out)

    shape = ", ".join(f"{c} {kinds[c]}" for c in key)
    return packed.select(*key, F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens")).mapInArrow(
        run, f"{shape}, tiles array<struct<q_block:bigint,k_block:bigint,cells:bigint,full:boolean>>, "
             "n_tiles bigint, skipped bigint, filled bigint, tested bigint")


def masked_tiles(tiled: DataFrame, key: Sequence[str] = SEQUENCE_KEY) -> DataFrame:
    """One row per tile with a true cell."""
    return tiled.select(*key, F.inline("tiles"))
