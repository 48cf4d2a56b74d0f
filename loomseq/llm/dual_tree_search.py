"""Exact top-k lexical search with a tree over documents and a tree over items.

A document is the vector of its terms' impacts, an item the vector of its terms'
weights, and a score their product. A node of either tree holds the largest
value of each coordinate below it, so the product of two nodes bounds every
score between them. A pair of nodes whose bound lies below the weakest k-th score
of the items in it is dropped as a whole; only equal or larger bounds are opened.

Documents that share their heaviest term stand next to each other, in blocks of
bounded size; a block's tree is built where it is searched. Items are cut into
blocks too, and every pair of blocks is one small task. k-th scores start from a
first search among documents that share an item's heaviest terms.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import spread_by
from .common import join_small, written

_KEPT = re.compile(rb"[0-9A-Za-z\x80-\xff]")
#: bytes of UTF-8: separators become blanks, A-Z small letters
_FOLD = bytes(b if _KEPT.match(bytes([b])) else 32 for b in range(256)).lower()


@dataclass(frozen=True)
class SearchSettings:
    #: documents of a block, on average half as many; documents of a leaf; children of a node
    block: int = 16_384
    leaf: int = 16
    fan: int = 8
    #: distinct terms, summed over its items, that a block of items holds on average
    item_terms: int = 16_384
    #: heaviest terms of an item, and documents of each, that the first search looks at
    probes: int = 3
    #: bound of the vocabulary that is sent to the tokenising tasks; beyond it they send all terms to a join
    terms: int = 200_000
    term_bytes: int = 8_000_000


# --- terms ---------------------------------------------------------------------------------------

def _count_terms(key: str, wanted: frozenset[bytes] | None, strip: int = 256):
    """Rows (key, row, n, words, tfs) of texts that have terms; ``words`` holds only wanted ones."""
    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, strip):
                part = batch.slice(at, strip)
                out = {name: [] for name in ("key", "row", "n", "words", "tfs")}
                for own, raw in zip(part.column(key).to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist()):
                    found = raw.translate(_FOLD).split() if raw else ()
                    if not found:
                        continue
                    counts = Counter(found if wanted is None else filter(wanted.__contains__, found))
                    for name, value in zip(out, (own, row, len(found), list(counts), list(counts.values()))):
                        out[name].append(value)
                    row += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(out["key"], part.schema.field(key).type), pa.array(out["row"], pa.int64()), pa.array(out["n"], pa.int64()),
                    pa.array(out["words"], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                    pa.array(out["tfs"], pa.list_(pa.int64()))], [key, "row", "n", "words", "tfs"])

    return run


def count_terms(texts: DataFrame, key: str, wanted: frozenset[bytes] | None = None) -> DataFrame:
    """Terms of ``texts`` (key, text): rows (key, row, n, words, tfs), a null or termless text has none.

    ``row`` numbers the rows, ``n`` counts all terms with repeats. With ``wanted``,
    the lists hold wanted terms only.
    """
    of_key = texts.schema[key].dataType.simpleString()
    rows = texts.select(key, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count_terms(key, wanted), f"{key} {of_key}, row long, n long, words array<string>, tfs array<long>")


def _known(vocabulary: DataFrame, settings: SearchSettings) -> frozenset[bytes] | None:
    """The vocabulary as a set if it lies within its bounds."""
    rows, size = vocabulary.agg(F.count(F.lit(1)), F.sum(F.octet_length("word"))).first()
    if rows > settings.terms or (size or 0) > settings.term_bytes:
        return None
    return frozenset(r["word"].encode() for r in vocabulary.toLocalIterator())


# --- the two trees -------------------------------------------------------------------------------

class _Tree:
    """Coordinate maxima, level by level from the leaves to the root, of rows in their order."""

    def __init__(self, leaves: np.ndarray, fan: int):
        self.fan, self.levels = fan, [leaves]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), fan), axis=0))

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        below = (nodes[:, None] * self.fan + np.arange(self.fan)).ravel()
        return below[below < len(self.levels[level - 1])]


class _Search:
    """Best documents of every item of one block among the documents of one block."""

    #: bounds are floating sums; they are raised by more than their rounding
    SLACK = 1 + 1e-9

    def __init__(self, docs: pa.Table, items: pa.Table, k: int, settings: SearchSettings):
        self.k, self.leaf, self.opened = k, settings.leaf, 0
        names = _flat(items, "words").dictionary_encode()
        item_of, self.columns = _owners(items, "words"), len(names.dictionary)
        weight = _flat(items, "weights").to_numpy(zero_copy_only=False).astype(np.int64)
        column = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # items that share their heaviest term stand next to each other
        heaviest = np.lexsort((column, -weight, item_of))
        head = column[heaviest[np.unique(item_of[heaviest], return_index=True)[1]]]
        self.items = np.argsort(head, kind="stable")
        place = np.empty(len(self.items), dtype=np.int64)
        place[self.items] = np.arange(len(self.items))
        self.weights = np.zeros((len(self.items), self.columns), dtype=np.int64)
        self.weights[place[item_of], column] = weight
        self.item_tree = _Tree(self.weights, settings.fan)
        floor = items.column("floor").to_numpy()[self.items]
        self.floor = np.maximum(floor, 1)  # scores above 0 count

        order = np.argsort(docs.column("sig").to_numpy(), kind="stable")
        docs = docs.take(pa.array(order))
        self.rows = docs.column("row").to_numpy()
        ids = docs.column("doc_id").combine_chunks()
        self.no_id = np.asarray(pc.is_null(ids).to_numpy(zero_copy_only=False), dtype=bool)
        self.ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        at = pc.index_in(_flat(docs, "words"), value_set=names.dictionary)
        here = pc.is_valid(at).to_numpy(zero_copy_only=False)
        owner = _owners(docs, "words")[here]
        tf = _flat(docs, "tfs").to_numpy(zero_copy_only=False)[here]
        self.column = pc.drop_null(at).to_numpy(zero_copy_only=False).astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * docs.column("m").to_numpy()[owner])
        self.start = np.searchsorted(owner, np.arange(len(self.ids) + 1))
        leaves = np.zeros((-(-len(self.ids) // self.leaf), self.columns), dtype=np.float32)  # impacts fit exactly
        np.maximum.at(leaves, (owner // self.leaf, self.column), self.impact.astype(np.float32))
        self.doc_tree = _Tree(leaves, settings.fan)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2 for _ in self.items]

    def run(self) -> None:
        top, docs_top = len(self.item_tree.levels) - 1, len(self.doc_tree.levels) - 1
        self._visit(top, 0, docs_top, np.zeros(1, dtype=np.int64))

    def _visit(self, level: int, node: int, doc_level: int, nodes: np.ndarray) -> None:
        span = self.item_tree.fan ** level
        weakest = self.floor[node * span:(node + 1) * span].min()
        vector = self.item_tree.levels[level][node]
        used = np.flatnonzero(vector)
        bounds = self.doc_tree.levels[doc_level][np.ix_(nodes, used)].astype(np.float64) @ vector[used].astype(np.float64)
        bounds *= self.SLACK
        open_ = bounds >= weakest
        nodes, bounds = nodes[open_], bounds[open_]
        if not len(nodes):
            return
        if level == 0 and doc_level == 0:
            self._score(node, nodes, bounds)
            return
        if doc_level:
            nodes, doc_level = self.doc_tree.children(doc_level, nodes), doc_level - 1
        below = [node] if level == 0 else self.item_tree.children(level, np.array([node]))
        for child in below:
            self._visit(max(level - 1, 0), int(child), doc_level, nodes)

    def _score(self, item: int, leaves: np.ndarray, bounds: np.ndarray, chunk: int = 64) -> None:
        """Scores of the documents of ``leaves``, best bounds first, until no bound reaches the k-th score."""
        order = np.argsort(-bounds, kind="stable")
        weights = self.weights[item]
        for at in range(0, len(order), chunk):
            some = order[at:at + chunk]
            if bounds[some[0]] < self.floor[item]:
                return
            self.opened += len(some)
            rows = (leaves[some][:, None] * self.leaf + np.arange(self.leaf)).ravel()
            rows = rows[rows < len(self.ids)]
            lengths = self.start[rows + 1] - self.start[rows]
            rows, lengths = rows[lengths > 0], lengths[lengths > 0]
            if not len(rows):
                continue
            begins = np.cumsum(lengths) - lengths
            terms = np.repeat(self.start[rows] - begins, lengths) + np.arange(lengths.sum())
            score = np.add.reduceat(weights[self.column[terms]] * self.impact[terms], begins)
            good = score >= self.floor[item]
            old = self.best[item]
            score, rows = np.concatenate((old[0], score[good])), np.concatenate((old[1], rows[good]))
            first = np.lexsort((self.ids[rows], self.no_id[rows], -score))[:self.k]
            self.best[item] = score[first], rows[first]
            if len(first) == self.k:
                self.floor[item] = max(self.floor[item], score[first[-1]])


def _flat(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks().flatten()


def _owners(table: pa.Table, name: str) -> np.ndarray:
    sizes = pc.list_value_length(table.column(name).combine_chunks()).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes)


def _search_blocks(k: int, settings: SearchSettings):
    def run(key, docs: pa.Table, items: pa.Table) -> pa.Table:
        names, out = ["item", "row", "doc_id", "score"], []
        if docs.num_rows and items.num_rows:
            search = _Search(docs, items, k, settings)
            search.run()
            item = items.column("item").to_numpy()[search.items]
            for own, (score, found) in zip(item, search.best):
                out.append(pa.table([
                    pa.array(np.full(len(found), own)), pa.array(search.rows[found]),
                    pa.array(search.ids[found], pa.int64(), mask=search.no_id[found]), pa.array(score)], names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 4, names)

    return run


def _best(docs: DataFrame, items: DataFrame, k: int, settings: SearchSettings) -> DataFrame:
    """Rows (item, row, doc_id, score, rank): the ``k`` best of ``docs`` (row, doc_id, m, sig, words, tfs) for each item."""
    half = settings.block // 2
    per_sig = written(docs.groupBy("sig").agg(F.count(F.lit(1)).alias("n")), "heaviest")
    total = per_sig.agg(F.sum("n")).first()[0] or 0
    doc_blocks = max(1, -(-total // half))
    terms = items.agg(F.sum(F.size("words"))).first()[0] or 0
    item_blocks = max(1, -(-terms // settings.item_terms))

    # documents of a frequent heaviest term are dealt to several blocks
    pieces = per_sig.select("sig", F.ceil(F.col("n") / half).alias("pieces"))
    piece = F.pmod(F.xxhash64("row"), F.col("pieces"))
    left = join_small(docs, pieces, ["sig"]).withColumn(
        "block", F.pmod(F.xxhash64("sig", piece), F.lit(doc_blocks)).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))))
    right = items.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(item_blocks)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(doc_blocks - 1))))
    left = spread_by(left.select("block", "part", "row", "doc_id", "m", "sig", "words", "tfs"), "block", "part")
    found = left.groupBy("block", "part").cogroup(
        right.select("block", "part", "item", "floor", "words", "weights").groupBy("block", "part")).applyInArrow(
        _search_blocks(k, settings), "item long, row long, doc_id long, score long")
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return written(found, "best").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = 20, settings: SearchSettings = SearchSettings()) -> DataFrame:
    """The ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Terms are runs of letters, digits and non-ASCII characters after lower-casing
    A-Z; weights, impacts and scores are integers. Returns item_id, rank (from 1),
    doc_id, score (above 0); equal scores go by ascending doc_id, a null doc_id
    last. Null, empty and termless texts match nothing. Each row is a document or
    an item of its own: documents that repeat take places of their own, an
    item that repeats is ranked once per row. Empty tables give no row, other
    columns are ignored, texts of any length are read whole.
    """
    spark = docs.sparkSession
    asked = written(count_terms(items.select("item_id", "text"), "item_id"), "item-terms")
    vocabulary = written(asked.select(F.explode("words").alias("word")).distinct(), "item-words")
    known = _known(vocabulary, settings)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counted = written(count_terms(texts, "doc_id", known), "document-terms")
    n_docs, length = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")

    seen = counted.select("row", F.explode("words").alias("word"))
    if known is None:
        seen = seen.join(vocabulary, "word", "left_semi")
    ratio = F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)
    terms = written(
        seen.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        .select("word", F.floor(1000 * F.log(ratio)).cast("bigint").alias("w")).where("w > 0"), "weights")
    # the code of a document's heaviest term: weight, then 40 bits of its hash
    code = F.shiftleft(F.col("w"), 40) + F.pmod(F.xxhash64("word"), F.lit(2**40))
    coded = terms.withColumn("code", code)
    heaviest = join_small(seen, coded.select("word", "code"), ["word"]).groupBy("row").agg(F.max("code").alias("sig"))
    m = 75 + F.expr(f"(25 * n * {n_docs}L) div {length}L")
    vectors = written(counted.join(heaviest, "row").select("row", "doc_id", m.alias("m"), "sig", "words", "tfs"), "vectors")

    pair = F.arrays_zip("words", "tfs")
    parts = asked.select(F.col("row").alias("item"), "item_id", F.explode(pair).alias("p"))
    parts = join_small(parts.select("item", "item_id", F.col("p.words").alias("word"), F.col("p.tfs").alias("q")), coded, ["word"])
    parts = written(parts, "item-weights")
    weighted = written(
        parts.groupBy("item", "item_id").agg(F.collect_list(F.struct("word", (F.col("q") * F.col("w")).alias("v"))).alias("l"))
        .select("item", "item_id", F.col("l.word").alias("words"), F.col("l.v").alias("weights")), "items")

    by = Window.partitionBy("item").orderBy(F.desc("code"))
    probes = parts.withColumn("r", F.row_number().over(by)).where(F.col("r") <= settings.probes).select(F.col("code").alias("sig")).distinct()
    near = Window.partitionBy("sig").orderBy("m", "row")
    first = join_small(vectors, written(probes, "probes"), ["sig"]).withColumn("r", F.row_number().over(near)).where(F.col("r") <= k)
    seeds = _best(written(first.drop("r"), "seeds"), weighted.withColumn("floor", F.lit(0).cast("bigint")), k, settings)
    floors = seeds.where(F.col("rank") == k).select("item", F.col("score").alias("floor"))
    started = written(weighted.join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0).cast("bigint"))), "floors")
    best = _best(vectors, started, k, settings)
    return best.join(started.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
