"""Per-token structure of a sequence as array columns of the same row.

The sequence is cut into runs at its pads and markers and every column is put
together run by run, so nothing is exploded, shuffled or appended token by token.
Positions are 0-based. ``tokens`` should be a plain column, not an expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _ints() -> Column:
    return F.array().cast("array<int>")


def positions_of(tokens: Column, token_id: int | None) -> Column:
    """Sorted positions of an id; empty when ``token_id`` is None."""
    if token_id is None:
        return _ints()
    at = F.transform(tokens, lambda t, i: F.when(t == token_id, i))
    return F.filter(at, lambda i: i.isNotNull())


def count_up(first: Column, length: Column) -> Column:
    """``length`` consecutive integers from ``first``; empty for length 0."""
    return F.when(length > 0, F.sequence(first, first + length - 1)).otherwise(_ints())


def runs_between(first: Column, inner: Column, end: Column) -> Column:
    """Structs ``(start, len)`` of the pieces of ``[first, end)`` cut at the sorted ``inner`` boundaries.

    Starts and ends are two shifted arrays zipped once; a lookup of the next
    boundary per element would evaluate the array again each time.
    """
    return F.zip_with(
        F.concat(F.array(first), inner), F.concat(inner, F.array(end)),
        lambda s, e: F.struct(s.alias("start"), (e - s).alias("len")))


def _after(positions: Column) -> Column:
    return F.transform(positions, lambda p: p + 1)


def _repeat_number(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r, k: F.array_repeat(k, r["len"])))


def add_structure(
    df: DataFrame,
    *,
    marker_id: int,
    pad_id: int | None,
    tokens: str = "tokens",
    ignore_label: int = -100,
) -> DataFrame:
    """Add segment, position, document, marker-group, distance, label and reach arrays.

    ``segment_id`` a pad opens the next segment; ``position_id`` counts within it
    ``mask_doc_id`` a pad closes its document; ``marker_group`` a marker closes its group
    ``since_marker`` ids since the latest marker at or before the position
    ``reach`` keys a query may attend to with markers (pads: none)
    ``reach_causal`` the same without markers (pads take part)
    """
    t = F.col(tokens)
    ignored = [i for i in (marker_id, pad_id) if i is not None]
    out = df.withColumn("__pad", positions_of(t, pad_id)).withColumn("__mark", positions_of(t, marker_id))
    whole = lambda inner: runs_between(F.lit(0), inner, F.size(t))
    out = (
        out.withColumn("__seg", whole(F.col("__pad"))).withColumn("__doc", whole(_after(F.col("__pad"))))
        .withColumn("__grp", whole(_after(F.col("__mark")))).withColumn("__gap", whole(F.col("__mark")))
    )
    seg, doc, grp, gap = (F.col(c) for c in ("__seg", "__doc", "__grp", "__gap"))
    marks_in = lambda d: F.filter(
        F.col("__mark"), lambda m: (m >= d["start"]) & (m < d["start"] + d["len"]))
    runs_in = F.transform(doc, lambda d: runs_between(d["start"], _after(marks_in(d)), d["start"] + d["len"]))
    out = out.withColumn("__runs", runs_in)
    # The j-th run of a document sees its own part so far and the j markers before it.
    reach = F.flatten(F.transform(F.col("__runs"), lambda rs: F.flatten(
        F.transform(rs, lambda r, j: count_up(j + 1, r["len"])))))
    if pad_id is not None:
        reach = F.zip_with(reach, t, lambda r, x: F.when(x == pad_id, F.lit(0)).otherwise(r))
    return (
        out.withColumn("segment_id", _repeat_number(seg))
        .withColumn("position_id", F.flatten(F.transform(seg, lambda r: count_up(F.lit(0), r["len"]))))
        .withColumn("mask_doc_id", _repeat_number(doc))
        .withColumn("marker_group", _repeat_number(grp))
        .withColumn("since_marker", F.flatten(F.transform(
            gap, lambda r, k: count_up(F.when(k == 0, F.lit(1)).otherwise(F.lit(0)), r["len"]))))
        .withColumn("label", F.transform(
            t, lambda x: F.when(x.isin(ignored), F.lit(ignore_label)).otherwise(x)))
        .withColumn("reach", reach)
        .withColumn("reach_causal", F.flatten(F.transform(doc, lambda r: count_up(F.lit(1), r["len"]))))
        .drop("__pad", "__mark", "__seg", "__doc", "__grp", "__gap", "__runs")
    )


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + x)


# --- masks as predicates over a query and a key position --------------------------------------

def marker_mask(q: Column, k: Column) -> Column:
    """Causal, same document, same marker group or a marker key; pads ask nothing."""
    return (
        (q["pos"] >= k["pos"]) & (q["doc"] == k["doc"])
        & ((q["group"] == k["group"]) | k["is_marker"]) & ~q["is_pad"]
    )


def causal_mask(q: Column, k: Column) -> Column:
    """Causal within the document; pads take part."""
    return (q["pos"] >= k["pos"]) & (q["doc"] == k["doc"])


def mask_cells(df: DataFrame, *, marker_id: int, pad_id: int | None, tokens: str = "tokens",
               out: str = "cells") -> DataFrame:
    """Array of ``(pos, token, doc, group, is_marker, is_pad)``, input of :func:`allowed_keys`."""
    s = add_structure(df, marker_id=marker_id, pad_id=pad_id, tokens=tokens)
    is_pad = lambda x: F.lit(False) if pad_id is None else x == pad_id
    cell = lambda t, i: F.struct(
        i.alias("pos"), t.alias("token"), F.get("mask_doc_id", i).alias("doc"),
        F.get("marker_group", i).alias("group"), (t == marker_id).alias("is_marker"), is_pad(t).alias("is_pad"))
    return s.withColumn(out, F.transform(tokens, cell)).select(*df.columns, out)


def with_key_lists(df: DataFrame, *, marker_id: int, pad_id: int | None, tokens: str = "tokens",
                   out: str = "keys") -> DataFrame:
    """Admitted keys of every query under :func:`marker_mask`, sorted.

    Built from the runs (a document's markers so far, then the own run), so the
    work is the size of the output and no pair is tested.
    """
    t = F.col(tokens)
    none = F.array().cast("array<int>")
    cut = (
        df.withColumn("__mark", positions_of(t, marker_id))
        .withColumn("__doc", runs_between(F.lit(0), _after(positions_of(t, pad_id)), F.size(t)))
        .withColumn("__doc", F.transform("__doc", lambda d: F.struct(
            d["start"].alias("start"), d["len"].alias("len"),
            F.filter("__mark", lambda m: (m >= d["start"]) & (m < d["start"] + d["len"])).alias("marks"))))
        .withColumn("__run", F.flatten(F.transform("__doc", lambda d: F.transform(
            runs_between(d["start"], _after(d["marks"]), d["start"] + d["len"]),
            lambda r, j: F.struct(r["start"].alias("start"), r["len"].alias("len"),
                                  F.slice(d["marks"], F.lit(1), j).alias("before"))))))
    )

    def keys(r, q):
        seen = F.concat(r["before"], F.sequence(r["start"], q))
        return seen if pad_id is None else F.when(F.get(t, q) == pad_id, none).otherwise(seen)

    return cut.withColumn(out, F.flatten(F.transform("__run", lambda r: F.transform(
        count_up(r["start"], r["len"]), lambda q: keys(r, q))))).select(*df.columns, out)


def allowed_keys(cells: Column, mask, *, causal: bool = True) -> Column:
    """Admitted key positions of every query position under any predicate ``mask(q, k)``.

    Evaluated inside the row of one sequence: quadratic in its length, no join
    and no row per pair. Counts come cheaper from the ``reach`` arrays.
    """
    keys = lambda q: F.slice(cells, F.lit(1), q["pos"] + 1) if causal else cells
    return F.transform(cells, lambda q: F.transform(F.filter(keys(q), lambda k: mask(q, k)), lambda k: k["pos"]))
