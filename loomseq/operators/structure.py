"""Per-token structure of sequences in long form (one row per token), as windows.

For sequences at rest in array form :mod:`loomseq.functions.structure` gives the
same columns without a shuffle. A window group here is one sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import int_div
from ..functions.structure import positions_of, runs_between
from ..session import materialise

SEQUENCE_KEY = ("epoch", "shard_idx", "rank", "bin")


def to_long(packed: DataFrame, key: Sequence[str] = SEQUENCE_KEY, tokens: str = "tokens") -> DataFrame:
    """One row per token."""
    return packed.select(*key, F.posexplode(tokens).alias("pos", "token"))


def _is(token_id: int | None) -> Column:
    return F.lit(False) if token_id is None else F.col("token") == token_id


def with_groups(long: DataFrame, *, marker_id: int, pad_id: int | None, key: Sequence[str] = SEQUENCE_KEY) -> DataFrame:
    """Add pad and marker flags, segment, document and marker-group ids."""
    so_far = Window.partitionBy(*key).orderBy("pos")
    flag = lambda c: F.col(c).cast("int")
    return (
        long.withColumn("is_pad", _is(pad_id)).withColumn("is_marker", _is(marker_id))
        .withColumn("segment_id", F.sum(flag("is_pad")).over(so_far))
        .withColumn("mask_doc_id", F.col("segment_id") - flag("is_pad"))
        .withColumn("marker_group", F.sum(flag("is_marker")).over(so_far) - flag("is_marker"))
    )


def with_positions(grouped: DataFrame, key: Sequence[str] = SEQUENCE_KEY) -> DataFrame:
    """Add ``position_id`` (0-based in the segment).

    A segment is contiguous, so its first position is a running maximum over the
    sequence window that is already there; no second partitioning is needed.
    """
    so_far = Window.partitionBy(*key).orderBy("pos")
    opened = F.max(F.when(F.col("is_pad") | (F.col("pos") == 0), F.col("pos"))).over(so_far)
    return grouped.withColumn("position_id", F.col("pos") - opened)


def with_since_marker(grouped: DataFrame, key: Sequence[str] = SEQUENCE_KEY) -> DataFrame:
    """Add ``since_marker``: distance to the latest marker, the whole prefix if there is none."""
    so_far = Window.partitionBy(*key).orderBy("pos")
    latest = F.max(F.when(F.col("is_marker"), F.col("pos"))).over(so_far)
    return grouped.withColumn("since_marker", F.coalesce(F.col("pos") - latest, F.col("pos") + 1))


def with_labels(long: DataFrame, *ignored: int, ignore_label: int = -100) -> DataFrame:
    """Add ``label``: the token, or ``ignore_label`` on the ignored ids."""
    return long.withColumn(
        "label", F.when(F.col("token").isin(*ignored), F.lit(ignore_label)).otherwise(F.col("token")))


def with_reach(grouped: DataFrame, key: Sequence[str] = SEQUENCE_KEY) -> DataFrame:
    """Add ``reach`` and ``reach_causal``: number of keys each query position may see.

    Closed form: the own run so far, plus the markers of the document before it.
    """
    so_far = Window.partitionBy(*key).orderBy("pos")
    before = F.lag("is_pad", 1, True).over(so_far)
    cut = F.lag(F.col("is_pad") | F.col("is_marker"), 1, True).over(so_far)
    marks = F.col("marker_group")  # markers before this position in the whole sequence
    at_doc = lambda value: F.last(F.when(F.col("__doc_opens"), value), ignorenulls=True).over(so_far)
    out = grouped.withColumn("__doc_opens", before).withColumn("__run_opens", cut)
    doc_start, marks_at_doc = at_doc(F.col("pos")), at_doc(marks)
    run_start = F.last(F.when(F.col("__run_opens"), F.col("pos")), ignorenulls=True).over(so_far)
    return (
        out.withColumn("doc_start", doc_start).withColumn("run_start", run_start)
        .withColumn("reach", F.when(F.col("is_pad"), F.lit(0)).otherwise(
            F.col("pos") - F.col("run_start") + 1 + marks - marks_at_doc).cast("bigint"))
        .withColumn("reach_causal", (F.col("pos") - F.col("doc_start") + 1).cast("bigint"))
        .drop("__doc_opens", "__run_opens")
    )


def distinct_segments(grouped: DataFrame, key: Sequence[str] = SEQUENCE_KEY) -> DataFrame:
    """Sorted distinct segment ids of every sequence."""
    return grouped.groupBy(*key).agg(F.array_sort(F.collect_set("segment_id")).alias("segments"))


def mask_blocks(
    reached: DataFrame, *, block: int = 128, use_markers: bool = True, key: Sequence[str] = SEQUENCE_KEY
) -> DataFrame:
    """Occupancy of the ``block x block`` tiles of the attention mask.

    ``cells`` admitted pairs, ``full`` when the tile is all true. Only tiles with
    a true cell are given. Pairs are never formed: tokens are counted once per
    run and block, and a run (or a document's markers) meets a later block as a
    product of two counts; the tiles on the diagonal add up per query position.
    """
    key = list(key)
    bit = lambda c: c.cast("bigint")
    run = F.col("run_start") if use_markers else F.col("doc_start")
    rows = (
        reached.withColumn("block", int_div(F.col("pos"), block)).withColumn("__run", run)
        .withColumn("__q", bit(~F.col("is_pad") if use_markers else F.lit(True)))
        .withColumn("__m", bit(F.col("is_marker") if use_markers else F.lit(False)))
    )
    in_block = Window.partitionBy(*key).orderBy("pos")
    own = F.col("pos") - F.greatest(F.col("__run"), F.col("block") * block) + 1
    # Markers of the document before this position, less those before the block.
    before = F.sum("__m").over(in_block) - F.col("__m")
    opens = (F.col("pos") == F.col("doc_start")) | (F.col("pos") % block == 0)
    rows = rows.withColumn("__before", before)
    marks = F.col("__before") - F.last(F.when(opens, F.col("__before")), ignorenulls=True).over(in_block)
    counted = materialise(
        rows.withColumn("__cells", F.col("__q") * (own + marks))
        .groupBy(*key, "mask_doc_id", "__run", "block").agg(
            F.sum("__q").alias("nq"), F.count(F.lit(1)).alias("nk"), F.sum("__m").alias("nm"),
            F.sum("__cells").alias("cells")))

    def later_blocks(group: list[str], keys: str) -> DataFrame:
        part = counted.groupBy(*key, *group, "block").agg(F.sum("nq").alias("nq"), F.sum(keys).alias("nk"))
        k = part.where("nk > 0").select(*key, *group, F.col("block").alias("k_block"), "nk")
        q = part.where("nq > 0").select(*key, *group, F.col("block").alias("q_block"), "nq")
        return q.join(k, [*key, *group]).where(F.col("k_block") < F.col("q_block")).select(
            *key, "q_block", "k_block", (F.col("nq") * F.col("nk")).alias("cells"))

    parts = counted.select(*key, F.col("block").alias("q_block"), F.col("block").alias("k_block"), "cells")
    parts = parts.unionByName(later_blocks(["__run"], "nk"))
    if use_markers:
        parts = parts.unionByName(later_blocks(["mask_doc_id"], "nm"))
    size = counted.groupBy(*key).agg(F.sum("nk").alias("__n"))
    edge = lambda b: F.least(F.lit(block), F.col("__n") - F.col(b) * block)
    return (
        parts.groupBy(*key, "q_block", "k_block").agg(F.sum("cells").alias("cells"))
        .where(F.col("cells") > 0).join(size, key)
        .withColumn("full", F.col("cells") == edge("q_block") * edge("k_block")).drop("__n")
    )


def mask_blocks_of(
    packed: DataFrame, *, marker_id: int, pad_id: int | None, block: int = 128, use_markers: bool = True,
    key: Sequence[str] = SEQUENCE_KEY, tokens: str = "tokens",
) -> DataFrame:
    """:func:`mask_blocks` from the runs of each sequence, in its row.

    A document meets a block in a stretch of positions that its markers cut into
    runs. Cells of a diagonal tile add up over these runs; a later block sees an
    earlier one of the same document through the earlier one's markers, and through
    a run that spans both. Rows leave only as partial sums of tiles.
    """
    key, t = list(key), F.col(tokens)
    pads, marks = positions_of(t, pad_id), positions_of(t, marker_id if use_markers else None)
    docs = F.filter(runs_between(F.lit(0), F.transform(pads, lambda p: p + 1), F.size(t)), lambda d: d["len"] > 0)
    rows = packed.select(*key, F.size(t).alias("__n"), marks.alias("__mark"), docs.alias("__doc"),
                         (pads if use_markers else F.array().cast("array<int>")).alias("__pad"))
    number = lambda position: F.floor(position / block).cast("int")
    inside = lambda positions, low, high: F.filter(positions, lambda p: (p >= low) & (p < high))

    def stretch(d, b):
        low, high = F.greatest(d["start"], b * block), F.least(d["start"] + d["len"], (b + 1) * block)
        return F.struct(b.alias("b"), low.alias("low"), high.alias("high"), inside(F.col("__mark"), low, high).alias("marks"),
                        F.array_contains("__pad", high - 1).cast("int").alias("pad"))

    def diagonal(s):
        # the j-th run sees its own part so far and j markers; a pad, last of its run, asks nothing
        runs = runs_between(s["low"], F.transform(s["marks"], lambda m: m + 1), s["high"])
        cells = F.transform(runs, lambda r, j: F.struct((r["len"] - F.when(r["start"] + r["len"] == s["high"], s["pad"]).otherwise(0)).alias("q"), j.alias("j")))
        return F.aggregate(cells, F.lit(0).cast("bigint"), lambda a, c: a + (c["q"] * (c["q"] + 1) / 2).cast("bigint") + c["q"] * c["j"])

    def pieces(d):
        blocks = F.sequence(number(d["start"]), number(d["start"] + d["len"] - 1))
        return F.transform(F.transform(blocks, lambda b: stretch(d, b)), lambda s: F.struct(
            s["b"].alias("b"), (s["high"] - s["low"] - s["pad"]).cast("bigint").alias("q"),
            (F.size(s["marks"]) if use_markers else s["high"] - s["low"]).cast("bigint").alias("k"), diagonal(s).alias("own")))

    def tiles(ps):
        return F.flatten(F.transform(ps, lambda q: F.transform(F.filter(ps, lambda k: k["b"] <= q["b"]), lambda k: F.struct(
            q["b"].cast("bigint").alias("q_block"), k["b"].cast("bigint").alias("k_block"),
            F.when(k["b"] == q["b"], q["own"]).otherwise(q["q"] * k["k"]).alias("cells")))))

    found = F.flatten(F.transform(F.transform("__doc", pieces), tiles))
    if use_markers:
        def spans(d):
            runs = runs_between(d["start"], F.transform(inside(F.col("__mark"), d["start"], d["start"] + d["len"]), lambda m: m + 1),
                                d["start"] + d["len"])
            return F.filter(runs, lambda r: number(r["start"]) < number(r["start"] + r["len"] - 1))

        def across(r):
            end = r["start"] + r["len"]
            size = lambda b: F.least(end, (b + 1) * block) - F.greatest(r["start"], b * block)
            asks = lambda b: size(b) - F.when((b == number(end - 1)) & F.array_contains("__pad", end - 1), 1).otherwise(0)
            later = F.sequence(number(r["start"]) + 1, number(end - 1))
            return F.flatten(F.transform(later, lambda q: F.transform(F.sequence(number(r["start"]), q - 1), lambda k: F.struct(
                q.cast("bigint").alias("q_block"), k.cast("bigint").alias("k_block"), (asks(q) * size(k)).cast("bigint").alias("cells")))))

        found = F.concat(found, F.flatten(F.transform(F.flatten(F.transform("__doc", spans)), across)))
    edge = lambda b: F.least(F.lit(block), F.col("__n") - F.col(b) * block)
    return (
        rows.select(*key, "__n", F.inline(found)).groupBy(*key, "q_block", "k_block")
        .agg(F.sum("cells").alias("cells"), F.max("__n").alias("__n")).where(F.col("cells") > 0)
        .withColumn("full", F.col("cells") == edge("q_block") * edge("k_block")).drop("__n")
    )
