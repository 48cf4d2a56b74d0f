"""Spelling variants of the words of a corpus, by FM-index search schemes.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. The error lies in one half of the word looked for, so the other
half stands exactly: the first scheme matches ``$`` and the first half exactly and
extends over the second half with one error, the second scheme does the same
from the end. Each direction has its own FM-index over the delimited vocabulary;
states are intervals of suffix ranks.

An index holds a block of words. A word is stored by its length and its first
(last) letters, and looked for where words of its length, one less and one more
with the same letters are stored, so a block meets only words that can match.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import spread_by
from .common import join_small, written

_LOWER = bytes(range(256)).lower()
#: fixed values of the typing model: one run in so many of a document loses a letter
TYPO = 199


@dataclass(frozen=True)
class VariantSettings:
    least_length: int = 6
    least_count: int = 5
    #: how many times as frequent a word's form must be
    ratio: int = 5
    #: words one index holds, on average
    block: int = 8_192
    #: words a counting task holds before it sends them on
    held: int = 200_000


# --- words ---------------------------------------------------------------------------------------

def _count_words(settings: VariantSettings, strip: int = 256):
    least = settings.least_length
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def table(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, strip):
                part = batch.slice(at, strip)
                for own, raw in zip(part.column("id").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist()):
                    if not raw:
                        continue
                    begin = zlib.crc32(f"{own}:".encode())
                    for word, n in Counter(runs.findall(raw.translate(_LOWER).decode())).items():
                        h = zlib.crc32(word.encode(), begin)
                        if h % TYPO == 0:
                            cut = h % len(word)
                            word = word[:cut] + word[cut + 1:]
                            if len(word) < least:
                                continue
                        counts[word] = counts.get(word, 0) + n
                    if len(counts) >= settings.held:
                        yield table(counts)
                        counts = {}
        yield table(counts)

    return run


def count_words(docs: DataFrame, settings: VariantSettings = VariantSettings()) -> DataFrame:
    """Rows (word, n) of the words of ``docs`` (doc_id, text) that are long and frequent enough."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_count_words(settings), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.least_count)


# --- index and search ----------------------------------------------------------------------------

class FMIndex:
    """Suffix ranks of ``$w1$w2$...$``, words given as sequences in the order in which a search consumes them.

    Symbol 0 ends the text, 1 is the delimiter. Memory is proportional to the text.
    """

    def __init__(self, words: list[np.ndarray]):
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        letters = np.unique(np.concatenate(words)) if len(words) else np.zeros(0, np.int64)
        self.letters = letters
        # a search prepends symbols, so the text holds the words backwards
        self.begin = np.cumsum(lengths + 1) - (lengths + 1)  # place of the delimiter before each word
        size = int((lengths + 1).sum()) + 1
        text = np.ones(size + 1, dtype=np.int64)
        for at, word in zip(self.begin, words):
            text[at + 1:at + 1 + len(word)] = np.searchsorted(letters, word[::-1]) + 2
        text[size] = 0
        self.rows = _suffixes(text)
        self.before = text[self.rows - 1]
        order = np.argsort(self.before, kind="stable")
        self.width = len(text) + 1
        # (symbol, row) in order: the place of (c, row) is the first suffix rank of c before that row
        self.keys = self.before[order] * self.width + order
        self.to = np.empty(len(order), dtype=np.int64)
        self.to[order] = np.arange(len(order))

    def codes(self, values: np.ndarray) -> np.ndarray:
        """Symbols of letters; letters that no word has get one that never occurs."""
        at = np.searchsorted(self.letters, values)
        known = at < len(self.letters)
        known[known] = self.letters[at[known]] == values[known]
        return np.where(known, at + 2, len(self.letters) + 2)

    def start(self, symbol: int = 1) -> tuple[int, int]:
        return tuple(np.searchsorted(self.keys, [symbol * self.width, (symbol + 1) * self.width]).tolist())

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more symbol."""
        base = symbols * self.width
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """All letters that extend each interval: (interval, symbol, low, high).

        Intervals of strings of one length are equal or disjoint, so the work
        is bounded by the text however many searches share an interval.
        """
        first, of = np.unique(low, return_inverse=True)
        last = np.zeros(len(first), dtype=np.int64)
        last[of] = high
        wide = last - first
        start = np.cumsum(wide) - wide
        row = np.repeat(first - start, wide) + np.arange(wide.sum())
        owner = np.repeat(np.arange(len(first)), wide)
        letter = self.before[row] > 1
        row, owner = row[letter], owner[letter]
        symbol = self.before[row]
        order = np.lexsort((row, symbol, owner))
        row, owner, symbol = row[order], owner[order], symbol[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])
        heads = np.flatnonzero(new)
        tails = np.append(heads, len(row))[1:] - 1
        owner, symbol, lows, highs = owner[heads], symbol[heads], self.to[row[heads]], self.to[row[tails]] + 1
        begin, count = np.searchsorted(owner, np.arange(len(first))), np.bincount(owner, minlength=len(first))
        per = count[of]
        at = np.repeat(begin[of] - (np.cumsum(per) - per), per) + np.arange(per.sum())
        return np.repeat(np.arange(len(low)), per), symbol[at], lows[at], highs[at]

    def words_at(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, word) of intervals of whole delimited words."""
        per = high - low
        row = np.repeat(low - (np.cumsum(per) - per), per) + np.arange(per.sum())
        return np.repeat(np.arange(len(low)), per), np.searchsorted(self.begin, self.rows[row])


def _suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling the compared length."""
    n, reach = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[:n - reach] = rank[reach:] + 1 if reach < n else 0
        pair = rank * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank, reach = fresh, reach * 2
        if rank[order[-1]] == n - 1:
            return order


def search(index: FMIndex, queries: list[np.ndarray], exact: np.ndarray, cells: int = 2**20):
    """(query, word) pairs at exactly one error, the first ``exact`` letters of each query free of errors.

    Every pair comes once: an inserted or deleted letter of a run of equal ones is
    taken to be the last.
    """
    lengths = np.array([len(q) for q in queries], dtype=np.int64)
    by_length = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(by_length):
        # queries of like length, as many as fit into a bounded table
        fits = (lengths[by_length[at:]] + 2) * np.arange(1, len(by_length) - at + 1) <= cells
        take = max(1, int(np.argmin(fits)) if not fits.all() else len(fits))
        some = by_length[at:at + take]
        at += take
        q, w = _search_some(index, [queries[i] for i in some], lengths[some], exact[some])
        yield some[q], w


def _search_some(index: FMIndex, queries: list[np.ndarray], m: np.ndarray, exact: np.ndarray):
    table = np.ones((len(queries), int(m.max()) + 1), dtype=np.int64)  # a delimiter follows each query
    flat = index.codes(np.concatenate(queries))
    for i, (end, size) in enumerate(zip(np.cumsum(m), m)):
        table[i, :size] = flat[end - size:end]
    own = np.arange(len(queries))
    low, high = (np.full(len(queries), v, dtype=np.int64) for v in index.start())
    waiting = []  # searches after their error: query, low, high, next letter
    for j in range(int(m.max()) + 1):
        left = (m[own] >= j) & (low < high)
        own, low, high = own[left], low[left], high[left]
        if not len(own):
            break
        here = exact[own] <= j
        q, a, b = own[here], low[here], high[here]
        if len(q):
            of, symbol, lo, hi = index.branches(a, b)
            who, expected = q[of], table[q[of], j]
            other = symbol != expected
            waiting.append((who[other], lo[other], hi[other], np.full(other.sum(), j)))  # inserted
            replaced = other & (m[who] > j)
            waiting.append((who[replaced], lo[replaced], hi[replaced], np.full(replaced.sum(), j + 1)))
            last = (m[q] > j) & (table[q, j] != table[q, np.minimum(j + 1, table.shape[1] - 1)])
            waiting.append((q[last], a[last], b[last], np.full(last.sum(), j + 1)))  # deleted
        go = m[own] > j
        own = own[go]
        low, high = index.step(table[own, j], low[go], high[go])
    who, low, high, at = (np.concatenate(c) for c in zip(*waiting)) if waiting else (np.zeros(0, np.int64),) * 4
    done = [(np.zeros(0, np.int64),) * 2]
    while len(who):
        low, high = index.step(table[who, at], low, high)
        alive = low < high
        over = alive & (at == m[who])
        of, word = index.words_at(low[over], high[over])
        done.append((who[over][of], word))
        go = alive & ~over
        who, low, high, at = who[go], low[go], high[go], at[go] + 1
    q, w = (np.concatenate(c) for c in zip(*done))
    return q, w


def _near_in_block(key, table):
    """Pairs (word, near, near_n) of one block; the key says from which side halves are matched."""
    forward = key[0].as_py()
    stored = table.column("stored").to_numpy(zero_copy_only=False).astype(bool)
    words, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
    kept = np.flatnonzero(stored)
    asked = sorted({words[i] for i in np.flatnonzero(~stored)})
    out: list[tuple[str, str, int]] = []
    if len(kept) and asked:
        letters = lambda w: np.frombuffer((w if forward else w[::-1]).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        index = FMIndex([letters(words[i]) for i in kept])
        sizes = np.array([len(w) for w in asked])
        exact = sizes // 2 if forward else sizes - sizes // 2
        for q, w in search(index, [letters(x) for x in asked], exact):
            for word, near, n in zip((asked[i] for i in q.tolist()), (words[i] for i in kept[w].tolist()), counts[kept[w]].tolist()):
                # the forward scheme finds words that begin with the same half
                if forward or not near.startswith(word[:len(word) // 2]):
                    out.append((word, near, n))
    word, near, n = zip(*out) if out else ((), (), ())
    return pa.table({"word": pa.array(word, pa.string()), "near": pa.array(near, pa.string()), "near_n": pa.array(n, pa.int64())})


def near_words(vocabulary: DataFrame, settings: VariantSettings = VariantSettings()) -> DataFrame:
    """Ordered pairs (word, near, near_n) of distinct words of ``vocabulary`` (word, n, written) that differ by one edit."""
    size = F.length("word")
    # letters that a stored word of this length has in common with any near word that shares a half
    shared = f"cast(greatest({settings.least_length // 2}, floor((length - 1) / 2)) as int)"
    sides = vocabulary.withColumn("forward", F.explode(F.array(F.lit(True), F.lit(False))))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", F.expr(f"if(forward, left(word, {shared}), right(word, {shared}))"))

    stored = placed(sides.withColumn("length", size))
    asked = placed(sides.withColumn("length", F.explode(F.sequence(size - 1, size + 1))).where(F.col("length") >= settings.least_length))
    key = ["forward", "length", "part"]
    # words of a frequent part are dealt to several blocks, and looked for in all of them
    hot = written(
        stored.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > settings.block)
        .select(*key, F.ceil(F.col("c") / settings.block).cast("int").alias("pieces")), "frequent-parts")
    blocks = max(1, -(-vocabulary.count() // settings.block))

    def block(piece: Column) -> Column:
        return F.pmod(F.xxhash64("length", "part", piece), F.lit(blocks)).cast("int")

    pieces = F.coalesce("pieces", F.lit(1))
    stored = join_small(stored, hot, key, "left").withColumn("block", block(F.pmod(F.xxhash64("word"), pieces).cast("int")))
    asked = join_small(asked, hot, key, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    asked = asked.withColumn("block", block(F.col("piece")))
    columns = ["forward", "block", "word", "n"]
    both = stored.select(*columns, F.lit(True).alias("stored")).unionByName(asked.select(*columns, F.lit(False).alias("stored")))
    return spread_by(both, "forward", "block").groupBy("forward", "block").applyInArrow(
        _near_in_block, "word string, near string, near_n long")


# --- forms ---------------------------------------------------------------------------------------

def group_variants(docs: DataFrame, settings: VariantSettings = VariantSettings()) -> DataFrame:
    """Frequent words of ``docs`` (doc_id, text) with the words they are variants of.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; some
    lose a letter by the typing model. Returns per word of the least length and
    count: word, n, n_near (words one edit away), form (the near word of
    largest n, of these the smallest, if it is ``ratio`` times as frequent, else
    null), form_n, root (the end of the chain of forms; the word itself if it has
    none). Null and empty texts have no words, a null doc_id counts as an empty
    text in the typing model, repeated rows count each, an empty table gives no
    row, other columns are ignored.
    """
    vocabulary = written(count_words(docs, settings), "vocabulary")
    pairs = written(near_words(vocabulary, settings), "near-words")
    # the smallest of (-n, word) is the most frequent, then the smallest word
    near = pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("top"))
    words = vocabulary.join(near, "word", "left")
    frequent = -F.col("top.k") >= settings.ratio * F.col("n")
    forms = written(words.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(frequent, F.col("top.near")).alias("form"), F.when(frequent, -F.col("top.k")).alias("form_n")), "forms")
    most = forms.agg(F.max("n")).first()[0] or 1
    # a form is ``ratio`` times as frequent as its word, so chains are short; each join doubles the way
    steps = max(1, math.ceil(math.log(max(most, settings.ratio), settings.ratio)))
    chain = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        chain = written(chain, "chains")
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chain = chain.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return forms.join(chain, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
