"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import new_folder

#: ASCII characters that are no word characters once A-Z is lower-cased
SEPARATORS = "".join(c for c in map(chr, range(128)) if not (c.isdigit() or c.islower()))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is the fast way and does the same unless the text holds another
    upper-case letter.
    """
    other = text.rlike(r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]")
    return F.when(other, F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """Words of a text: runs of a-z, digits and non-ASCII characters after lower-casing A-Z; null has none."""
    inner = F.btrim(lower_ascii(text), F.lit(SEPARATORS))
    return F.when(F.length(inner) > 0, F.split(inner, _GAP)).otherwise(F.array().cast("array<string>"))


def shifted(array: Column, by: int) -> Column:
    """The array without its first ``by`` values."""
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and go on from the files.

    A lost executor then costs no recomputation, and several readers share the
    work. Partitions and order of the result are those of the files. Shuffle files
    of the step go once its table is there: else they stay until the driver happens
    to collect its garbage.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if (folders := _passing.get()) is not None:
        folders.append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing() -> Iterator[list[str]]:
    """Collects the folders of the tables that are written inside, for :func:`remove` when nothing reads them any more."""
    token = _passing.set([])
    try:
        yield _passing.get()
    finally:
        _passing.reset(token)


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Delete tables of :func:`written`."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: rows of fixed width up to which the smaller side of a join is broadcast
BROADCAST_ROWS = 250_000


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a written table on the right: broadcast within the bound, else shuffled, where adaptive execution splits hot keys."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)


def smallest_hashes(rows: DataFrame, column: str, count: int) -> DataFrame:
    """Rows whose hash in ``column`` is among the ``count`` smallest distinct ones.

    The hashes alone are ranked, after all but about twice as many as wanted are
    left out by their value; what the driver gets doesn't grow with the rows or partitions.
    """
    hashes = rows.select(column).distinct()
    known = hashes.count()
    if known <= count:
        return rows
    near = hashes.where(F.col(column) <= F.lit(min(-(2**63) + int(2**64 * min(1.0, (2 * count + 100) / known)), 2**63 - 1)))
    near = near if near.count() >= count else hashes
    last = near.orderBy(column).limit(count).agg(F.max(column)).first()[0]
    return rows.where(F.col(column) <= last)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) whose doc_id and hash of the text aren't in ``gone`` (doc_id, print)."""
    keys = gone.select(F.col("doc_id").alias("__id"), F.col("print").alias("__print"))
    same = docs["doc_id"].cast("bigint").eqNullSafe(keys["__id"]) & (F.xxhash64(docs["text"].cast("string")) == keys["__print"])
    return docs.join(keys, same, "left_anti")


def _fingerprint(links: DataFrame) -> tuple:
    # xor-free checksum that can't overflow: sums of 31-bit hashes
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(2**31)))).first())


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected ``links`` (a, b): rows (node, component), component = smallest node.

    Alternates two steps until nothing changes: hang larger neighbours of each
    node below its smallest one, then do the same among smaller neighbours. A
    node's smallest neighbour is an aggregate with map-side combination, so a
    node with very many links is combined before the shuffle; the join that
    sends it back reads two written tables, which lets adaptive execution split
    a hot node. Self-links are dropped; nodes without links don't appear.
    """
    links = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _fingerprint(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "lowest")
        large = written(
            both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        lowest = written(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        moved = large.join(lowest, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
        links = written(moved.select("l.*").where("a <> b").distinct(), "links")
        before, state = state, _fingerprint(links)
        if state == before:
            break
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def spanning(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Smallest position reachable from each of ``size`` positions over the pairs."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        if (low == label[a]).all() and (low == label[b]).all():
            return label
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
