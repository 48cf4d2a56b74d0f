"""Benchmark decontamination by winnowing, with DataFrame functions only.

A fingerprint is the smallest hash among the k-grams of a window of words; every
window that a document shares with an item gives the same fingerprint on both
sides, so every shared span of at least one window is found. Equal fingerprints
are extended to whole windows, which are compared word by word.

A document stays in its row while its fingerprints are made, and these meet the
benchmark's in a broadcast join, in blocks of bounded size: no document is
shuffled, and a passage that most documents share is no hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shifted, without, words, written

#: words of a window
WINDOW = 13
#: words of a hashed k-gram
GRAM = 8
#: windows of the benchmark that are broadcast at once
BLOCK = 100_000


def _paired(left: Column, right: Column, combine) -> Column:
    """Combine two arrays place by place, as far as both reach."""
    size = F.least(F.size(left), F.size(right))
    return F.zip_with(F.slice(left, 1, size), F.slice(right, 1, size), combine)


def _hashes(df: DataFrame, ws: str, lengths: list[int], window: int, gram: int) -> tuple[DataFrame, dict[int, str]]:
    """Add an array of fingerprints per window length; position i is that of the window at word i.

    Windows of full length have the minimum of their k-grams' hashes; shorter
    ones, whole items, the hash of all their words.
    """
    df = df.withColumn("__h1", F.transform(ws, lambda w: F.xxhash64(w)))
    powers = [1]
    while powers[-1] * 2 <= max([gram, *[n for n in lengths if n < window]]):
        p = powers[-1]
        df = df.withColumn(f"__h{2 * p}", _paired(
            F.col(f"__h{p}"), shifted(F.col(f"__h{p}"), p), lambda a, b: F.xxhash64(a, b)))
        powers.append(2 * p)

    def gram_hash(n: int) -> Column:
        out, done = None, 0
        for p in reversed(powers):
            if n - done >= p:
                part = shifted(F.col(f"__h{p}"), done)
                out = part if out is None else _paired(out, part, lambda a, b: F.xxhash64(a, b))
                done += p
        return out

    names = {}
    for n in lengths:
        names[n] = f"__f{n}"
        if n < window:
            df = df.withColumn(names[n], gram_hash(n))
            continue
        df = df.withColumn("__m1", gram_hash(gram))
        span, have = window - gram + 1, 1
        while have < span:
            step = min(have, span - have)
            df = df.withColumn(f"__m{have + step}", _paired(
                F.col(f"__m{have}"), shifted(F.col(f"__m{have}"), step), lambda a, b: F.least(a, b)))
            have += step
        df = df.withColumn(names[n], F.col(f"__m{span}"))
    return df, names


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows of every item: (item_id, len, win); ``win`` are its words, separated by spaces."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws")).where("size(ws) > 0")
    length = F.least(F.size("ws"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(1), F.size("ws") - length + 1))
    return items.select("item_id", length.alias("len"), "ws", starts.alias("i")).select(
        "item_id", "len", F.array_join(F.slice("ws", F.col("i"), F.col("len")), " ").alias("win")).distinct()


def find_windows(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK):
    """The documents with ``doc_id``, ``print`` (hash of the text) and ``n_words``, and the windows that they share.

    Returns (documents, shared, windows): ``shared`` has (doc_id, print, at, len,
    win), ``windows`` (item_id, len, win).
    """
    windows = written(benchmark_windows(benchmark, window), "windows")
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect()) or [window]
    texts = windows.select("len", "win").distinct().withColumn("ws", F.split("win", " "))
    prints = None
    for n in lengths:
        hashed, names = _hashes(texts.where(F.col("len") == n), "ws", [n], window, gram)
        part = hashed.select("len", "win", F.element_at(names[n], 1).alias("fingerprint"))
        prints = part if prints is None else prints.unionByName(part)
    prints = written(prints, "prints")
    blocks = max(1, -(-prints.count() // block))
    prints = prints.withColumn("block", F.pmod(F.xxhash64("win"), F.lit(blocks)))

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("print"), words(F.col("text")).alias("ws"))
    hashed, names = _hashes(rows, "ws", lengths, window, gram)
    # position -1 stands for the document itself
    itself = F.struct(F.lit(0).alias("len"), F.array(F.lit(None).cast("bigint")).alias("prints"))
    per_length = F.array(itself, *[F.struct(F.lit(n).alias("len"), F.col(c).alias("prints")) for n, c in names.items()])
    keep = ["doc_id", "print", "ws"]
    placed = hashed.select(*keep, F.explode(per_length).alias("w")).select(
        *keep, F.col("w.len").alias("len"), F.posexplode("w.prints").alias("at", "fingerprint"))
    found = []
    for k in range(blocks):
        part = prints.where(F.col("block") == k).select("fingerprint", F.col("len").alias("wlen"), "win")
        joined = placed.join(F.broadcast(part), "fingerprint", "left")
        same = (F.col("len") == F.col("wlen")) & (
            F.array_join(F.slice("ws", F.col("at") + 1, F.col("len")), " ") == F.col("win"))
        found.append(joined.where(same | ((F.col("len") == 0) & F.lit(k == 0))).select(
            "doc_id", "print", F.when(F.col("len") == 0, F.size("ws")).alias("n_words"), "at", "len", "win"))
    found = written(reduce(DataFrame.unionByName, found), "shared-windows")
    documents = found.where("len = 0").select("doc_id", "print", F.col("n_words").cast("bigint").alias("n_words"))
    shared = found.where("len > 0").select("doc_id", "print", "at", "len", "win").distinct()
    return documents, shared, windows


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """How much of each document of ``docs`` (doc_id, text) stands in items of ``benchmark`` (item_id, text).

    One row per input row: doc_id, print (hash of the text), n_words, n_hit (words
    inside any shared window), n_items (items with shared windows), items_sha256
    (of their ids, sorted as strings, comma-joined), contaminated (at least one hit,
    and hits are at least a twentieth of the words). Windows are ``window``
    consecutive item words; a shorter item is one window. Null and wordless texts
    have no words and no hits; items without words are none. Words of an item with a null
    id are hit like others, but the item isn't named or counted, as it has no id.
    Repeated rows each get their row; other columns are ignored.
    """
    documents, shared, windows = find_windows(docs, benchmark, window=window, gram=gram)
    key = ["doc_id", "print"]
    end = F.col("at") + F.col("len")
    before = Window.partitionBy(*key).orderBy("at", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = shared.select(*key, "at", end.alias("end")).withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
    hits = covered.groupBy(*key).agg(
        F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("at", "reached"))).alias("n_hit"))
    of_doc = shared.select(*key, "win").distinct().join(windows.where("item_id IS NOT NULL"), "win").groupBy(*key).agg(
        F.array_sort(F.collect_set("item_id")).alias("items"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["print"] == b["print"])
    out = documents.join(hits, same(documents, hits), "left").select(documents["*"], "n_hit")
    out = out.join(of_doc, same(out, of_doc), "left").select(out["*"], "items")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "print", "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    found = contamination(docs, benchmark, window=window, gram=gram).where("contaminated")
    return without(docs, found)
