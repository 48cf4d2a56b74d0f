"""Joins against lookup tables, with sizes and hot keys looked at first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import materialise

#: rows and bytes up to which the small side is broadcast
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 128 * 2**20
#: keys looked up apart from the rest, and counters of the sketch that finds them
HOT_KEYS, SKETCH_COUNTERS = 1_000, 16_384


def fits_broadcast(table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table lies within the bounds; strings count by their bytes, other values as eight."""
    sizes = [F.octet_length(f.name) if f.dataType.simpleString() in ("string", "binary") else F.lit(8) for f in table.schema.fields]
    total = sum((F.coalesce(s, F.lit(0)) for s in sizes), F.lit(0))
    rows, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def frequent_values(rows: DataFrame, column: str, most: int = HOT_KEYS, counters: int = SKETCH_COUNTERS) -> DataFrame:
    """``(column, n)`` of the most frequent values by a frequent-items sketch.

    Sketches of fixed size are filled where the rows are and merged. Every value
    that makes up more than about one part in ``counters`` of the rows is among
    them if ``most`` values are no more frequent.
    """
    top = F.call_function("approx_top_k", F.col(column), F.lit(most), F.lit(counters))
    found = rows.where(F.col(column).isNotNull()).agg(top.alias("top"))
    return found.select(F.inline("top")).toDF(column, "n")


def join_bounded(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", *, max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a large left side with a lookup table on the right.

    Within its bounds the lookup table is broadcast. Beyond them the most frequent
    values of the first key column are looked up in a broadcast of their own rows,
    and all others, none of them hot, by a shuffled join; the left side is then
    read three times, so write it first where that is dear. ``how`` is inner, left,
    left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    on = list(on)
    if fits_broadcast(right, max_rows):
        return left.join(F.broadcast(right), on, how)
    hot = materialise(frequent_values(left, on[0]).select(on[0]))
    # nulls match nothing and would meet in one task
    apart = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    marked = left.join(apart, on[0], "left").withColumn("__hot", F.coalesce("__hot", F.col(on[0]).isNull()))
    known = right.join(F.broadcast(hot), on[0], "left_semi")
    columns = left.columns
    frequent, others = marked.where("__hot").select(*columns), marked.where("NOT __hot").select(*columns)
    # a key column may have several rows per hot value; the sketch bounds the values, this the rows
    side = F.broadcast(known) if fits_broadcast(known) else known
    return frequent.join(side, on, how).unionByName(others.join(right.hint("merge"), on, how))
