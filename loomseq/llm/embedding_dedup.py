"""Near-duplicate vectors by cross-polytope hashing.

A hash rotates the unit vector with three rounds of random signs and a Hadamard
transform and takes the closest of the +-axes. Two such hashes make a bucket
code of one table. Every vector is stored in its own bucket of each table and
also looks into the next-likeliest buckets (multiprobe). Vectors that meet in a
bucket are compared exactly, in blocks.

Exact copies are one vector with a count. A bucket of any size is compared in
tiles of bounded size. A tile returns link counts and the edges of a spanning
forest, never its pairs; a pair that meets in several places counts in the first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, spanning, written


@dataclass(frozen=True)
class HashSettings:
    tables: int = 5
    probes: int = 6
    #: vectors of a bucket that one tile takes from either side
    block: int = 1024
    seed: int = 20240

    @property
    def hashes(self) -> int:
        return 2 * self.tables


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row, unit-scaled; the width is a power of two."""
    n, width = rows.shape
    step, out = 1, rows
    while step < width:
        pair = out.reshape(n, width // (2 * step), 2, step)
        out = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), axis=2).reshape(n, width)
        step *= 2
    return out / np.sqrt(width)


def bucket_codes(unit: np.ndarray, settings: HashSettings) -> np.ndarray:
    """Codes of ``probes`` buckets, the vector's own first: (vectors, tables, probes)."""
    n, dim = unit.shape
    width = 1 << max(2, (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = unit
    rng = np.random.default_rng([settings.seed, width])
    reach = 4  # axes looked at per hash
    axes, loss = [], []
    for _ in range(settings.hashes):
        y = padded
        for _ in range(3):
            y = hadamard(y * rng.choice((-1.0, 1.0), width))
        size = np.abs(y)
        top = np.argsort(-size, axis=1, kind="stable")[:, :reach]
        best = np.take_along_axis(size, top, 1)
        axes.append(2 * top + (np.take_along_axis(y, top, 1) < 0))
        loss.append((best[:, :1] - best) ** 2)
    out = np.empty((n, settings.tables, settings.probes), dtype=np.int64)
    for t in range(settings.tables):
        a, b = 2 * t, 2 * t + 1
        code = (axes[a][:, :, None] * (2 * width) + axes[b][:, None, :]).reshape(n, -1)
        cost = (loss[a][:, :, None] + loss[b][:, None, :]).reshape(n, -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, : settings.probes]
        out[:, t] = np.take_along_axis(code, order, 1)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _place_rows(settings: HashSettings):
    """Rows (label, dim, slot, code, stored, node, copies, vector, codes) for every bucket a vector stands in."""
    schema = ("label long, dim int, slot int, code long, stored boolean, node long, copies long, "
              "vector array<double>, codes array<long>")

    def run(batches):
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()):
                part = batch.filter(pa.array(batch.column("dim").to_numpy() == dim))
                codes = bucket_codes(_unit(_matrix(part.column("vector"))), settings)
                n, tables, probes = codes.shape
                per = tables * probes
                rows = np.repeat(np.arange(n), per)
                flat = pa.array(codes.reshape(-1)[(rows[:, None] * per + np.arange(per)).reshape(-1)])
                yield pa.RecordBatch.from_pydict({
                    "label": part.column("label").take(pa.array(rows)),
                    "dim": part.column("dim").take(pa.array(rows)),
                    "slot": pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), n)),
                    "code": pa.array(codes.reshape(-1)),
                    "stored": pa.array(np.tile(np.arange(probes) == 0, n * tables)),
                    "node": part.column("node").take(pa.array(rows)),
                    "copies": part.column("copies").take(pa.array(rows)),
                    "vector": part.column("vector").take(pa.array(rows)),
                    "codes": pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * per + 1, per, dtype=np.int32)), flat),
                })

    return run, schema


def _first_meeting(codes: np.ndarray, a: np.ndarray, b: np.ndarray, slot: int, code: int) -> np.ndarray:
    """Whether this bucket is the first place where the vectors ``a`` and ``b`` meet."""
    mine = np.ones(len(a), dtype=bool)
    for t in range(slot + 1):
        own_a, own_b = codes[a, t, 0], codes[b, t, 0]
        at_a = (codes[b, t] == own_a[:, None]).any(axis=1)  # b looks into a's bucket
        at_b = (codes[a, t] == own_b[:, None]).any(axis=1)
        if t < slot:
            mine &= ~(at_a | at_b)
        else:
            far = np.iinfo(np.int64).max
            mine &= np.minimum(np.where(at_a, own_a, far), np.where(at_b, own_b, far)) == code
    return mine


def _compare_tile(settings: HashSettings, threshold: float, strip: int = 256):
    def run(key, table):
        slot, code = key[2].as_py(), key[3].as_py()
        left, right = key[4].as_py(), key[5].as_py()
        table = table.combine_chunks()
        node = table.column("node").to_numpy()
        by = np.argsort(node, kind="stable")  # positions then follow the ids
        node, stored = node[by], table.column("stored").to_numpy()[by]
        copies, block = table.column("copies").to_numpy()[by], table.column("block").to_numpy()[by]
        unit = _unit(_matrix(table.column("vector").combine_chunks()))[by]
        codes = _matrix_of_longs(table.column("codes").combine_chunks())[by].reshape(
            len(node), settings.tables, settings.probes)
        links = np.zeros(len(node), dtype=np.int64)
        edges = []
        for first in range(0, len(node), strip):
            a = np.arange(first, min(first + strip, len(node)))
            near = unit[a] @ unit[first:].T >= threshold
            near &= np.arange(first, len(node))[None, :] > a[:, None]
            near &= stored[a][:, None] | stored[first:][None, :]
            if left != right:
                near &= block[a][:, None] != block[first:][None, :]
            i, j = np.nonzero(near)
            i, j = a[i], j + first
            if not len(i):
                continue
            label = spanning(i, j, len(node))
            hung = np.flatnonzero(label != np.arange(len(node)))
            edges.append(np.stack((node[hung], node[label[hung]])))
            here = _first_meeting(codes, i, j, slot, code)
            links += np.bincount(i[here], copies[j[here]], len(node)).astype(np.int64)
            links += np.bincount(j[here], copies[i[here]], len(node)).astype(np.int64)
        linked = np.flatnonzero(links)
        a, b = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), dtype=np.int64)
        return pa.table({
            "a": pa.array(np.concatenate((node[linked], a))), "b": pa.array(np.concatenate((node[linked], b))),
            "n": pa.array(np.concatenate((links[linked], np.zeros(len(a), dtype=np.int64))))})

    return run


def _matrix_of_longs(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _usable(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def link_vectors(vectors: DataFrame, *, threshold: float = 0.98, settings: HashSettings = HashSettings()) -> DataFrame:
    """Links and components of ``vectors`` (vec_id, embedding, label).

    Compared are vectors of one label and length, by cosine in double precision.
    Returns one row per input row: vec_id, n_links (rows linked directly),
    component_id (smallest vec_id reachable), kept (vec_id = component_id). A null
    label, a null vec_id, and a vector that is null, zero, or holds null or
    non-finite values link with nothing: no links, their own component, kept.
    Rows that repeat a vec_id are vectors like others. Other columns are ignored;
    an empty table gives no row.
    """
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"),
        F.col("label").cast("bigint").alias("label"))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector")))
    nodes = written(
        usable.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
        # nodes are named by content, as ids may repeat
        .withColumn("dim", F.size("vector")).withColumn("vec_id", F.col("node"))
        .withColumn("node", F.xxhash64("label", "vector")), "vectors")

    place, schema = _place_rows(settings)
    placed = nodes.select("label", "dim", "node", "copies", "vector").mapInArrow(place, schema)
    bucket = ["label", "dim", "slot", "code"]
    placed = written(placed, "buckets")
    sizes = placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.max("stored").alias("any")).where("n > 1 and any")
    sizes = written(sizes.select(*bucket, F.ceil(F.col("n") / settings.block).cast("int").alias("blocks")), "bucket-sizes")
    spread = placed.join(sizes, bucket).withColumn(
        "block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    tiles = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *bucket, F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
        "stored", "node", "copies", "vector", "codes", "block")
    found = written(
        tiles.groupBy(*bucket, "left", "right").applyInArrow(
            _compare_tile(settings, threshold), "a long, b long, n long"), "vector-links")

    smallest = components(found.where("a <> b").select("a", "b"))
    linked = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    in_part = nodes.join(smallest, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = in_part.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    per_node = written(
        in_part.join(lowest, "component").join(linked, "node", "left").select(
            "label", "vector", "component_id",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-results")
    usable_row = F.col("vec_id").isNotNull()
    out = rows.withColumn("key", F.when(usable_row, F.col("label"))).join(
        per_node.withColumnRenamed("label", "key"), ["key", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
