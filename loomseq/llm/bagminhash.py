"""Near-duplicate documents by weighted Jaccard similarity of their shingles.

A document is the multiset of its five-word shingles (all words, if fewer). Its
BagMinHash signature keeps for each of m places the earliest point of Poisson
processes that belong to the shingles: the weight axis of a shingle is cut into
(0, 1], (1, 2], (2, 4], ..., each piece has a process of its own with points at
(time, weight, place), and a document takes those below its weight. Two
signatures agree at a place with probability equal to the weighted Jaccard
similarity. Points come in order of time, so a process ends once it is later
than everything in the signature.

Signatures are banded. Documents of one multiset are one node. In a bucket each
node is first compared with the smallest one. Buckets whose nodes then are of
more than one component are compared in tiles of bounded size, which return the
edges of a spanning forest. So no pairs are listed within a group, and no link
between components is missed. Similarity is verified on whole multisets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import components, spanning, written

SLICE_BYTES = 6_000_000
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class BagSettings:
    words: int = 5
    bands: int = 24
    rows: int = 6
    threshold: float = 0.8
    #: documents of a bucket that one tile takes from either side
    block: int = 512

    @property
    def places(self) -> int:
        return self.bands * self.rows


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit generator: every bit of ``x`` reaches every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    for c in range(128):
        if not chr(c).isalnum():
            table[c] = 32
        elif chr(c).isupper():
            table[c] = c + 32
    return table


def word_lists(texts: pa.Array) -> pa.ListArray:
    """Words of each text: runs of a-z, digits and non-ASCII characters after lower-casing A-Z; null has none."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    clean = pa.StringArray.from_buffers(
        len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(_byte_table()[raw]))
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(clean))


def shingle_bags(texts: pa.Array, words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingle hashes of each text, sorted, and their counts."""
    import xxhash

    lists = word_lists(texts)
    coded = lists.flatten().dictionary_encode()
    digest = xxhash.xxh64_intdigest
    names = coded.dictionary.to_pylist()
    hashes = mixed(np.fromiter((digest(w) for w in names), dtype=np.uint64, count=len(names)))
    stream = hashes[coded.indices.to_numpy()]
    blank = np.array([w == "" for w in names], dtype=bool)[coded.indices.to_numpy()]
    begin = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    rolled = np.zeros(max(len(stream) - words + 1, 0), dtype=np.uint64)
    for k in range(words):
        rolled = rolled * _M2 + stream[k : len(stream) - words + 1 + k] if len(rolled) else rolled
    rolled = mixed(rolled)
    out = []
    for a, b in zip(begin.tolist(), begin[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1], return_counts=True))
        elif b == a or blank[a]:
            out.append((np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)))
        else:
            h = np.uint64(b - a)
            for x in stream[a:b]:
                h = mixed(np.array([h]))[0] ^ x
            out.append((mixed(np.array([h])), np.ones(1, dtype=np.int64)))
    return out


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], places: int) -> np.ndarray:
    """Earliest time of each place: (documents, places); infinite for empty multisets."""
    sizes = np.array([len(h) for h, _ in bags])
    doc = np.repeat(np.arange(len(bags)), sizes)
    shingle = np.concatenate([h for h, _ in bags]) if len(doc) else np.zeros(0, dtype=np.uint64)
    weight = np.concatenate([n for _, n in bags]).astype(np.float64) if len(doc) else np.zeros(0)
    pieces = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    level = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    doc, shingle, weight = np.repeat(doc, pieces), np.repeat(shingle, pieces), np.repeat(weight, pieces)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.maximum(low, 1.0)
    seed = mixed(shingle + level.astype(np.uint64) * _M1)
    time = np.zeros(len(doc))
    out = np.full((len(bags), places), np.inf)
    flat = out.reshape(-1)
    step = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(doc):
            step += np.uint64(1)
            first = mixed(seed + step * _GOLDEN)
            time = time - np.log1p(-((first >> np.uint64(11)) * 2.0**-53)) / (width * places)
            second = mixed(first ^ _M2)
            place = ((second >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)
            taken = low + (second & np.uint64(0xFFFFFFFF)) * 2.0**-32 * width < weight
            np.minimum.at(flat, (doc * places + place)[taken], time[taken])
            live = np.flatnonzero(np.bincount(doc, minlength=len(bags)))
            latest = np.zeros(len(bags))
            latest[live] = out[live].max(axis=1)
            on = time < latest[doc]
            doc, seed, time, low, width, weight = (x[on] for x in (doc, seed, time, low, width, weight))
    return out


def band_keys(signature: np.ndarray, settings: BagSettings) -> np.ndarray:
    """A bucket number for each band of each signature."""
    parts = signature.view(np.uint64).reshape(len(signature), settings.bands, settings.rows)
    key = np.broadcast_to(mixed(np.arange(1, settings.bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for k in range(settings.rows):
        key = mixed(key * _M1 ^ parts[:, :, k])
    return key.view(np.int64)


def _node(bag: tuple[np.ndarray, np.ndarray]) -> int:
    import xxhash

    digest = xxhash.xxh64_intdigest(np.ascontiguousarray(np.concatenate((bag[0], bag[1].astype(np.uint64)))))
    return digest - 2**64 if digest >= 2**63 else digest


def _slices(texts: pa.Array):
    total = np.cumsum(pc.binary_length(pc.fill_null(texts, "")).to_numpy())
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + SLICE_BYTES, "right")))
        yield first, last
        first = last
    pa.default_memory_pool().release_unused()


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.append(0, np.cumsum([len(a) for a in arrays])).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64) if kind == pa.int64() else values, kind))


def _sketch(settings: BagSettings):
    def run(batches):
        for batch in batches:
            for first, last in _slices(batch.column(2)):
                bags = shingle_bags(batch.column(2).slice(first, last - first), settings.words)
                keys = band_keys(signatures(bags, settings.places), settings)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(first, last - first), "ref": batch.column(1).slice(first, last - first),
                    "print": batch.column(3).slice(first, last - first),
                    "node": pa.array([_node(b) if len(b[0]) else None for b in bags], pa.int64()),
                    "n_shingles": pa.array([int(b[1].sum()) for b in bags], pa.int64()),
                    "buckets": pa.ListArray.from_arrays(
                        pa.array(np.arange(0, keys.size + 1, settings.bands, dtype=np.int32)), pa.array(keys.reshape(-1)))})

    return run, "doc_id long, ref long, print long, node long, n_shingles long, buckets array<long>"


def _bags_of(settings: BagSettings):
    def run(batches):
        for batch in batches:
            for first, last in _slices(batch.column(1)):
                bags = shingle_bags(batch.column(1).slice(first, last - first), settings.words)
                part = pa.RecordBatch.from_pydict({
                    "node": batch.column(0).slice(first, last - first),
                    "shingles": _lists([b[0] for b in bags], pa.int64()), "counts": _lists([b[1] for b in bags], pa.int32())})
                same = [bool(len(b[0])) and _node(b) == n for b, n in zip(bags, part.column(0).to_pylist())]
                yield part.filter(pa.array(same, pa.bool_()))

    return run, "node long, shingles array<long>, counts array<int>"


def _verify(settings: BagSettings):
    def bag(batch, name):
        keys, counts = batch.column(f"{name}_shingles"), batch.column(f"{name}_counts")
        return keys.flatten().to_numpy().view(np.uint64), counts.flatten().to_numpy(), keys.offsets.to_numpy() - keys.offsets[0].as_py()

    def run(batches):
        for batch in batches:
            (ka, na, oa), (kb, nb, ob) = bag(batch, "a"), bag(batch, "b")
            keep = np.zeros(len(batch), dtype=bool)
            for i in range(len(batch)):
                x, y = ka[oa[i] : oa[i + 1]], kb[ob[i] : ob[i + 1]]
                nx, ny = na[oa[i] : oa[i + 1]], nb[ob[i] : ob[i + 1]]
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int(np.minimum(nx, ny[at])[y[at] == x].sum())
                keep[i] = both >= settings.threshold * (int(nx.sum()) + int(ny.sum()) - both) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run, "a long, b long"


def _overlaps(bags: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """Sizes of the multiset overlaps between the bags at ``left`` and those at ``right``."""
    sizes = [int(n.sum()) for _, n in bags]
    owner = np.repeat(np.arange(len(bags)), sizes)
    # the k-th copy of a shingle is an element of its own: overlaps of sets then count copies
    element = np.concatenate([
        mixed(np.repeat(h, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64) * _GOLDEN)
        for h, n in bags])
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    first = np.append(True, element[1:] != element[:-1])
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1 if len(column) else column
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, chunk):
        part = slice(np.searchsorted(column, begin), np.searchsorted(column, begin + chunk))
        dense = np.zeros((len(bags), chunk), dtype=np.float32)
        dense[owner[part], column[part] - begin] = 1
        out += dense[left] @ dense[right].T
    return np.rint(out).astype(np.int64)


def _compare_tile(settings: BagSettings):
    def run(key, table):
        left, right = key[1].as_py(), key[2].as_py()
        table = table.combine_chunks()
        node, part, block = (table.column(c).to_numpy() for c in ("node", "component", "block"))
        bags = [(np.array(h, dtype=np.int64).view(np.uint64), np.array(n)) for h, n in zip(
            (x.values.to_numpy() for x in table.column("shingles")), (x.values.to_numpy() for x in table.column("counts")))]
        x, y = np.flatnonzero(block == left), np.flatnonzero(block == right)
        size = np.array([int(n.sum()) for _, n in bags])
        links = np.zeros((2, 0), dtype=np.int64)
        if len(x) and len(y):
            both = _overlaps(bags, x, y)
            near = both >= settings.threshold * (size[x][:, None] + size[y][None, :] - both) - 1e-9
            near &= part[x][:, None] != part[y][None, :]
            i, j = np.nonzero(near)
            hung = spanning(x[i], y[j], len(node))
            links = np.stack((node, node[hung]))[:, hung != np.arange(len(node))]
        return pa.table({"a": pa.array(links[0]), "b": pa.array(links[1])})

    return run


def near_classes(docs: DataFrame, settings: BagSettings = BagSettings()) -> DataFrame:
    """Rows (doc_id, print, n_shingles, class, component_id): ``class`` names the class of a text with words, ``component_id`` is its smallest doc_id."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "ref", F.coalesce("doc_id", F.xxhash64("text"))).withColumn("print", F.xxhash64("text"))
    sketch, schema = _sketch(settings)
    sketched = written(rows.select("doc_id", "ref", "text", "print").mapInArrow(sketch, schema), "sketches")
    nodes = written(
        sketched.where("node IS NOT NULL").groupBy("node").agg(F.min("ref").alias("ref"), F.first("buckets").alias("buckets")), "nodes")
    placed = nodes.select("node", F.explode("buckets").alias("bucket"))
    lowest = written(
        placed.groupBy("bucket").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "low"),
        "bucket-leaders")
    crowded = written(placed.join(lowest, "bucket"), "crowded")

    bags, schema = _bags_of(settings)
    wanted = nodes.join(crowded.select("node").distinct(), "node").select("node", "ref")
    texts = rows.select("ref", "text").join(wanted, "ref").select("node", "text")
    bag_of = written(texts.mapInArrow(bags, schema).dropDuplicates(["node"]), "bags")
    verify, schema = _verify(settings)

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda name: bag_of.select(
            F.col("node").alias(name), F.col("shingles").alias(f"{name}_shingles"), F.col("counts").alias(f"{name}_counts"))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(verify, schema)

    stars = written(crowded.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "stars")
    links = written(verified(stars), "star-links")
    part = components(links)
    crowded = written(
        crowded.join(part, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")), "parts")
    # a bucket of two has been compared by now
    apart = crowded.groupBy("bucket").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y AND n > 2")
    apart = written(apart.select("bucket", F.ceil(F.col("n") / settings.block).cast("int").alias("blocks")), "apart")
    rest = crowded.join(apart, "bucket").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    tiles = rest.join(bag_of, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
        "block", "node", "component", "shingles", "counts")
    more = written(tiles.groupBy("bucket", "left", "right").applyInArrow(_compare_tile(settings), "a long, b long"), "more-links")
    part = components(links.unionByName(more))

    named = sketched.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    classes = named.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = written(classes.join(lows, "component").select("node", F.col("component").alias("class"), "component_id"), "classes")
    found = sketched.join(classes, "node", "left")
    return found.select("doc_id", "print", "n_shingles", "class", "component_id")


def near_duplicates(docs: DataFrame, settings: BagSettings = BagSettings()) -> DataFrame:
    """Classes of ``docs`` (doc_id, text) linked by weighted Jaccard similarity at or over the threshold.

    One row per input row: doc_id, print (hash of the text), n_shingles, component_id (smallest doc_id of
    the class), kept (doc_id = component_id). Null, empty and wordless texts are
    classes of their own. A row with a null doc_id takes the class of its likes; it is
    kept only if none of them has an id, or if it has no words. Rows that repeat a
    doc_id are documents like others. Other columns are ignored; an empty table gives no row.
    """
    return near_classes(docs, settings).select(
        "doc_id", "print", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.col("component_id").isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame, settings: BagSettings = BagSettings()) -> DataFrame:
    """One row of each class of ``docs``, with all its columns; texts without words all stay.

    It is the row of the smallest doc_id, null after all others, then of the smallest
    hash of the text, then one of the rows that are equal in both.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    key = [F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("print")]
    found = near_classes(rows.drop("__row"), settings).where("class IS NOT NULL")
    classes = found.select(F.col("doc_id").alias("of"), F.col("print").alias("of_print"), "class").distinct()
    slim = rows.select("__row", *key)
    named = written(slim.join(classes, slim["id"].eqNullSafe(classes["of"]) & (slim["print"] == classes["of_print"])).select(
        "__row", "class", F.struct(F.col("id").isNull().alias("none"), "id", "print", "__row").alias("place")), "classed")
    first = named.groupBy("class").agg(F.min("place").alias("first"))
    gone = named.join(first, "class").where("place.__row <> first.__row").select("__row")
    return rows.join(gone, "__row", "left_anti").drop("__row")
