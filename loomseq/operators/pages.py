"""Token shards as fixed pages, and documents cut out of the pages they overlap.

A page is a row of at most ``page`` tokens, so no row grows with its shard. A
document meets its pages by an interval join: both sides carry the page number,
and the overlap of a document and a page is a slice of either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import int_div

#: tokens of a page
PAGE = 65_536


def _overlaps(rows: DataFrame, start: Column, end: Column, page: int) -> DataFrame:
    """One row per page that ``[start, end)`` overlaps, with the overlap ``[__low, __high)`` in shard offsets."""
    pages = F.sequence(int_div(start, page), int_div(end - 1, page))
    out = rows.where(end > start).withColumn("page", F.explode(pages))
    return out.withColumn("__low", F.greatest(start, F.col("page") * page)).withColumn(
        "__high", F.least(end, (F.col("page") + 1) * page))


def _cut(tokens: str, origin: Column) -> Column:
    """The overlap out of tokens that begin at ``origin``."""
    return F.slice(tokens, (F.col("__low") - origin + 1).cast("int"), (F.col("__high") - F.col("__low")).cast("int"))


def _stitched(parts: DataFrame, *key: str) -> DataFrame:
    return parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__low", "__part"))).alias("__p")).select(
        *key, F.flatten(F.col("__p.__part")).alias("tokens"))


def page_shards(rows: DataFrame, page: int = PAGE) -> DataFrame:
    """``(shard_idx, page, tokens)`` of document rows ``(shard_idx, start, tokens)``.

    Documents of a shard follow each other without gaps from offset 0; all pages but
    a shard's last are full.
    """
    start = F.col("start")
    placed = _overlaps(rows.select("shard_idx", "start", "tokens"), start, start + F.size("tokens"), page)
    return _stitched(placed.select("shard_idx", "page", "__low", _cut("tokens", start).alias("__part")), "shard_idx", "page")


def slice_pages(pages: DataFrame, doc_index: DataFrame, page: int = PAGE) -> DataFrame:
    """``(shard_idx, doc_ix, tokens)`` of the documents of ``doc_index`` (shard_idx, doc_ix, start, end).

    Documents inside one page are done after the join; only the parts of those
    across pages are gathered. Empty documents have no page and don't appear.
    """
    wanted = _overlaps(doc_index.select("shard_idx", "doc_ix", "start", "end"), F.col("start"), F.col("end"), page)
    parts = wanted.join(pages.withColumnRenamed("tokens", "__tokens"), ["shard_idx", "page"]).withColumn(
        "__part", _cut("__tokens", F.col("page") * page))
    whole = (F.col("__low") == F.col("start")) & (F.col("__high") == F.col("end"))
    key = ["shard_idx", "doc_ix"]
    inside = parts.where(whole).select(*key, F.col("__part").alias("tokens"))
    return inside.unionByName(_stitched(parts.where(~whole).select(*key, "__low", "__part"), *key))
