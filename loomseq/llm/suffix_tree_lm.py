"""Scores of texts under a probabilistic suffix tree, next to a smoothed word model.

The tree predicts the bytes of a text (A-Z lower-cased, words separated by one
space, an end mark behind). A context of up to ``depth`` bytes stays in the
tree if it is frequent enough and its next-byte distribution diverges from that
of its longest proper suffix by a likelihood-ratio test at a fixed level. The
distribution of a context is smoothed with that of its suffix. The tree becomes
an automaton whose state is the longest context that ends at the current byte.
It is broadcast, so its contexts are bounded by ``depth / min_share`` at any size.

What is too rare for such a context comes in by whole words, whose counts stay
in Spark and have no bound: the chance of a word is its share in the training
texts, mixed at a fixed weight with the chance that the tree spells it behind
the bytes before it. The two weigh alike whatever the size of the corpus; an
unknown word has the second part alone. Whether a space or the end follows a
word is left to the tree.

Counts of byte windows and of words come from all training texts and are
combined before the shuffle. Words are joined with their counts by hash; the
few words that make up more than ``COMMON_SHARE`` of the corpus, at most
``1 / COMMON_SHARE`` of them, are looked up in the scan, so no join key is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: share of the corpus from which on a word is looked up in the scan: at most 500,000 words of 16 bytes
COMMON_SHARE = 2e-6
#: bytes that mark the end and the space before the start; neither occurs in prepared UTF-8
END, START = 0x0A, 0xFF
#: bytes of text worked on at once: when counting, where large slices combine more, and when scoring
SLICE_BYTES, SCORE_BYTES = 2_500_000, 800_000
#: steps that the automaton makes along each segment
SEGMENT = 256


@dataclass(frozen=True)
class TreeSettings:
    depth: int = 6
    #: least share of the corpus' bytes that follow a context
    min_share: float = 5e-6
    #: normal quantile of the level of the likelihood-ratio test (one in a thousand)
    level: float = 3.09
    #: weight of a word's own share in its chance; the rest is the weight of its spelling
    trust: float = 0.2


# --- texts -----------------------------------------------------------------------------------

def prepared(texts: pa.Array) -> tuple[pa.ListArray, pa.Array]:
    """Words of each text, and the words joined by one space; null is empty."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = pc.ascii_split_whitespace(trimmed)
    return words, pc.binary_join(words, " ")


def _slices(texts: pa.Array, size: int = SLICE_BYTES):
    """Bounds of runs of texts with about ``size`` bytes."""
    total = np.cumsum(pc.binary_length(texts).to_numpy())
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + size, "right")))
        yield first, last
        first = last
    pa.default_memory_pool().release_unused()


def byte_stream(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each after ``depth`` start marks and before an end mark; start of each text's own bytes."""
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    sizes = np.diff(offsets)
    begin = np.cumsum(sizes + depth + 1) - (sizes + 1)  # of each text in the stream
    out = np.full(int((sizes + depth + 1).sum()), START, dtype=np.uint8)
    body = np.repeat(begin - (offsets[:-1] - offsets[0]), sizes) + np.arange(int(sizes.sum()))
    out[body] = raw[offsets[0] : offsets[-1]]
    out[begin + sizes] = END
    return out, np.append(begin, len(out) + depth)


def window_counts(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of ``depth`` bytes and the byte behind, packed into integers, and their counts."""
    if not len(texts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    stream, begin = byte_stream(texts, depth)
    packed = np.zeros(len(stream) - depth, dtype=np.int64)
    for k in range(depth + 1):
        packed = (packed << 8) | stream[k : len(stream) - depth + k]
    inside = np.ones(len(packed), dtype=bool)
    for k in range(depth):  # windows that end in the start marks of the next text
        inside[begin[1:-1] - depth - depth + k] = False
    return np.unique(packed[inside], return_counts=True)


def word_hashes(distinct: pa.Array) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct)).view(np.int64)


# --- the tree --------------------------------------------------------------------------------

class Automaton:
    """Longest-context states with log10 probabilities of the next byte."""

    def __init__(self, depth: int, symbol: np.ndarray, step: np.ndarray, log: np.ndarray):
        self.depth, self.symbol, self.next, self.log = depth, symbol, step, log

    @property
    def arrays(self) -> tuple:
        return self.depth, self.symbol, self.next, self.log

    @classmethod
    def grown(cls, depth: int, rows: pa.Table) -> Automaton:
        """``rows``: (len, ctx, sym, n, apart) of the frequent contexts, the empty one included."""
        size, ctx, sym, n, apart = (rows.column(c).to_numpy() for c in ("len", "ctx", "sym", "n", "apart"))
        seen = np.unique(sym[size == 0])
        symbol = np.full(256, len(seen), dtype=np.int64)
        symbol[seen] = np.arange(len(seen))
        width = len(seen) + 1
        keep = {(0, 0)}
        for s, c in set(zip(size[apart].tolist(), ctx[apart].tolist())):
            for last in range(s + 1):  # prefixes, and suffixes of those
                head = c >> (8 * (s - last))
                keep.update((k, head & ((1 << (8 * k)) - 1)) for k in range(last + 1))
        # every state is a frequent context: its occurrences include those of one that was kept
        states = sorted(keep)
        number = {state: i for i, state in enumerate(states)}
        own = np.fromiter((number.get(k, -1) for k in zip(size.tolist(), ctx.tolist())), np.int64, len(size))
        counts = np.zeros((len(states), width))
        has = own >= 0
        np.add.at(counts, (own[has], symbol[sym[has]]), n[has])
        modelled = np.zeros(len(states), dtype=bool)
        modelled[own[has & apart]] = True
        step = np.zeros((len(states), width), dtype=np.int32)
        chance = np.empty((len(states), width))
        total = counts[0].sum()
        chance[0] = (counts[0] + 1) / (total + 256)
        link = np.array([number[(k - 1, c & ((1 << (8 * (k - 1))) - 1))] if k else 0 for k, c in states])
        extended = [[] for _ in states]
        for i, (k, c) in enumerate(states):
            if k:
                extended[number[(k - 1, c >> 8)]].append((symbol[c & 255], i))
        for i, (k, _) in enumerate(states):  # shorter ones first
            if k:
                step[i] = step[link[i]]
                chance[i] = chance[link[i]]
                if modelled[i]:
                    kinds = np.count_nonzero(counts[i])
                    chance[i] = (counts[i] + kinds * chance[i]) / (counts[i].sum() + kinds)
            for a, target in extended[i]:
                step[i, a] = target
        return cls(depth, symbol, step, np.log10(chance).astype(np.float32))

    def scores(self, texts: pa.Array) -> np.ndarray:
        """log10 probability of each text, spelled from its start to its end."""
        symbols, begin, at = self.walk(texts)
        spelled = np.append(0.0, np.cumsum(np.where(at >= 0, self.log.reshape(-1)[at], 0), dtype=float))
        return spelled[begin[1:] - self.depth] - spelled[begin[:-1]]

    def spelled(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of each text, in order: log10 probability that the tree spells it up to its boundary, and that the boundary is
        the space or end that it is. The blank word of an empty text has only its end, as probability. Also, for each word, log10 of the
        probability that a text isn't empty where it is the first of one, else 0."""
        symbols, begin, at = self.walk(texts)
        log = self.log.reshape(-1)
        own = log[at]
        space, end = self.symbol[0x20], self.symbol[END]
        inside = at >= 0  # own bytes and end marks, not the start marks
        # symbols of bytes that never occur share one number, so bytes are compared
        bound = np.flatnonzero(inside & ((symbols == 0x20) | (symbols == END)))
        state = at[bound] - self.symbol[symbols[bound]]
        either = np.log10(10.0 ** log[state + space].astype(float) + 10.0 ** log[state + end].astype(float))
        own[~inside] = 0.0
        own[bound] = 0.0
        total = np.append(0.0, np.cumsum(own, dtype=float))
        first = np.isin(bound, begin[:-1])  # an end without a word before it
        ends = symbols[bound] == END
        opens = np.append(True, ends[:-1])[: len(ends)]
        starts = begin[:-1]
        empty = log[at[starts] - self.symbol[symbols[starts]] + end].astype(float)
        some = np.zeros(len(bound))
        some[opens] = np.log10(1 - 10.0**empty)
        some[first] = 0.0
        word = np.where(first, 0.0, np.diff(np.append(0.0, total[bound])) + either - some)
        return word, log[at[bound]] - np.where(first, 0.0, either), some

    def walk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The byte stream, where texts begin in it, and the place of each own byte in the automaton's tables (-1 for start marks).

        Long texts are cut into segments that start with ``depth`` bytes to find the state.
        """
        stream, begin = byte_stream(texts, self.depth)
        lengths = begin[1:] - begin[:-1] - self.depth
        pieces = -(-lengths // SEGMENT)
        text = np.repeat(np.arange(len(lengths)), pieces)
        ordinal = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begin[:-1][text] + ordinal * SEGMENT
        span = np.minimum(SEGMENT, lengths[text] - ordinal * SEGMENT)
        order = np.argsort(-span, kind="stable")
        text, start, span = text[order], start[order], span[order]
        symbols = self.symbol[stream]
        width, step = self.next.shape[1], self.next.reshape(-1)
        state = np.zeros(len(text), dtype=np.int64)
        places = np.full(len(stream), -1, dtype=np.int64 if self.log.size >= 2**31 else np.int32)
        for k in range(-self.depth, int(span.max(initial=0))):
            live = len(span) if k < 0 else int(np.searchsorted(-span, -k, "left"))
            at = state[:live] * width + symbols[start[:live] + k]
            if k >= 0:
                places[start[:live] + k] = at
            state[:live] = step[at]
        return stream, begin, places


def frequent_contexts(windows: DataFrame, settings: TreeSettings) -> DataFrame:
    """Contexts with at least the least share: rows (len, ctx, sym, n, apart), ``apart`` if it passes the divergence test.

    ``windows`` (key, n) are packed windows. Contexts that hold the end mark don't occur.
    """
    total = windows.agg(F.sum("n")).first()[0] or 0
    sizes = F.explode(F.sequence(F.lit(0), F.lit(settings.depth)))
    mask = F.expr("shiftleft(1L, 8 * len) - 1")
    per = windows.select("key", "n", sizes.alias("len")).select(
        "len", F.shiftright("key", 8).bitwiseAND(mask).alias("ctx"),
        F.col("key").bitwiseAND(255).cast("int").alias("sym"), "n")
    per = per.groupBy("len", "ctx", "sym").agg(F.sum("n").alias("n"))
    all_of = per.groupBy("len", "ctx").agg(F.sum("n").alias("all")).where(
        (F.col("all") >= settings.min_share * total) | (F.col("len") == 0))
    frequent = written(per.join(all_of, ["len", "ctx"]), "contexts")
    shorter = frequent.select(
        (F.col("len") + 1).alias("len"), F.col("ctx").alias("suffix"), "sym", (F.col("n") / F.col("all")).alias("q"))
    own = frequent.where("len > 0").withColumn("suffix", F.col("ctx").bitwiseAND(F.expr("shiftleft(1L, 8 * (len - 1)) - 1")))
    # twice the gain in log-likelihood is distributed as chi-squared; its quantile by the cube-root approximation
    free = F.greatest(F.count(F.lit(1)) - 1, F.lit(1)) * 1.0
    quantile = free * F.pow(1 - 2 / (9 * free) + settings.level * F.sqrt(2 / (9 * free)), F.lit(3.0))
    gain = own.join(shorter, ["len", "suffix", "sym"]).groupBy("len", "ctx").agg(
        (2 * F.sum(F.col("n") * F.log(F.col("n") / F.col("all") / F.col("q"))) >= quantile).alias("apart"))
    return frequent.join(gain, ["len", "ctx"], "left").select(
        "len", "ctx", "sym", "n", F.coalesce("apart", F.lit(False)).alias("apart"))


# --- the two scans ---------------------------------------------------------------------------

def _count(depth: int):
    def run(batches):
        for batch in batches:
            texts, train = batch.column(0), batch.column(1)
            for first, last in _slices(pc.fill_null(texts, "")):
                use = train.slice(first, last - first)
                words, joined = prepared(texts.slice(first, last - first))
                coded = words.flatten().dictionary_encode()
                of_text = np.repeat(use.to_numpy(zero_copy_only=False), pc.list_value_length(words).to_numpy())
                codes = coded.indices.to_numpy()
                everywhere = np.bincount(codes, minlength=len(coded.dictionary))
                learnt = np.bincount(codes[of_text], minlength=len(coded.dictionary))
                real = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
                hashes = word_hashes(coded.dictionary)[real]
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array(np.zeros(len(hashes), dtype=np.int8)), "key": pa.array(hashes),
                    "n": pa.array(learnt[real]), "everywhere": pa.array(everywhere[real])})
                keys, n = window_counts(joined.filter(use), depth)
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array(np.ones(len(keys), dtype=np.int8)), "key": pa.array(keys),
                    "n": pa.array(n), "everywhere": pa.array(n)})

    return run, "kind tinyint, key long, n long, everywhere long"


def _score(model, common, shares):
    """Rows (row, key, slot, n, x): slot 0 a rare word and how it is spelled, the others what is known of the text itself."""

    def run(batches):
        automaton, (common_keys, common_counts) = Automaton(*model.value), common.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, last in _slices(pc.fill_null(batch.column(1), ""), SCORE_BYTES):
                part = batch.slice(first, last - first)
                words, joined = prepared(part.column(1))
                coded = words.flatten().dictionary_encode()
                distinct = len(coded.dictionary)
                text = np.repeat(np.arange(len(part)), pc.list_value_length(words).to_numpy())
                code = coded.indices.to_numpy()
                hashes = word_hashes(coded.dictionary)
                blank = ~pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(common_keys, hashes), max(len(common_keys) - 1, 0))
                is_common = (common_keys[at] == hashes) & ~blank if len(common_keys) else np.zeros(distinct, dtype=bool)
                count = np.where(is_common, common_counts[at] if len(common_keys) else 0, 0)
                base = np.bincount(text, np.log10(count + 1)[code], len(part))
                known = np.bincount(text, (count > 0)[code], len(part)).astype(np.int64)
                tokens = np.bincount(text, ~blank[code], len(part)).astype(np.int64) + 1
                word, kind, some = automaton.spelled(joined)
                rest = ~(is_common | blank)[code]
                of_count, of_spelling = shares  # of one occurrence, of the whole chance
                mixed = np.log10(of_count * count[code] + of_spelling * 10.0**word)
                mixed = np.where(count[code] > 0, mixed, word + np.log10(of_spelling))
                score = np.bincount(text, kind + some + np.where(is_common[code], mixed, 0.0), len(part))
                mine = row + np.arange(len(part))
                row += len(part)
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(np.concatenate((mine[text[rest]], np.tile(mine, 3)))),
                    "key": pa.array(np.concatenate((hashes[code[rest]], np.tile(mine, 3)))),
                    "slot": pa.array(np.repeat(np.arange(4, dtype=np.int8), (int(rest.sum()), *[len(part)] * 3))),
                    "n": pa.concat_arrays([pa.array(np.ones(int(rest.sum()), dtype=np.int64)), part.column(0), pa.array(2 * tokens + part.column(2).to_numpy(
                        zero_copy_only=False)), pa.array(known)]),
                    "x": pa.array(np.concatenate((word[rest].astype(np.float32), base, score, np.zeros(len(part)))))})

    return run, "row long, key long, slot tinyint, n long, x double"


def score_texts(docs: DataFrame, *, held_out: Column, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text), learning from those where ``held_out`` isn't true.

    Returns one row per input row: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (words, each text ended by one more token, add-one
    smoothed), score (log10 probability of the text: words by their counts, smoothed with their spelling by the tree).
    Null text is empty: its end mark alone. A null ``held_out`` (null doc_id) counts
    as learning. Rows are scored one by one, repeated ones too; with nothing to learn
    from, the tree is uniform and every word spelled by it. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"))
    count, schema = _count(settings.depth)
    counts = rows.select("text", ~F.col("held_out")).mapInArrow(count, schema)
    counts = written(counts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("everywhere").alias("everywhere")), "counts")
    words = counts.where("kind = 0")
    ends = rows.where(~F.col("held_out")).count()
    known, learnt, everywhere = words.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 0, 1)), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)),
        F.coalesce(F.sum("everywhere"), F.lit(0))).first()
    total, distinct = learnt + ends, known + (ends > 0)

    table = frequent_contexts(counts.where("kind = 1").select("key", "n"), settings).toArrow()
    model = spark.sparkContext.broadcast(Automaton.grown(settings.depth, table).arrays)
    common = words.where(F.col("everywhere") >= COMMON_SHARE * max(everywhere, 1)).select("key", "n").toArrow().sort_by("key")
    common = spark.sparkContext.broadcast(tuple(common.column(c).to_numpy() for c in ("key", "n")))

    shares = (settings.trust / learnt, 1 - settings.trust) if learnt else (0.0, 1.0)
    score, schema = _score(model, common, shares)
    found = rows.select("doc_id", "text", "held_out").mapInArrow(score, schema)
    rare = words.where((F.col("everywhere") < COMMON_SHARE * max(everywhere, 1)) & (F.col("n") > 0)).select(
        "key", F.col("n").alias("c"))
    joined = found.join(rare.hint("shuffle_hash"), "key", "left")
    is_word, c = F.col("slot") == 0, F.coalesce("c", F.lit(0))
    # a long unknown word has a chance below the least double, so unknown ones stay logarithms
    chance = F.when(c > 0, F.log10(c * F.lit(shares[0]) + F.lit(shares[1]) * F.pow(F.lit(10.0), F.col("x")))).otherwise(
        F.col("x") + F.log10(F.lit(shares[1])))
    per = joined.groupBy("row").agg(
        F.max(F.when(F.col("slot") == 1, F.col("n"))).alias("doc_id"),
        F.max(F.when(F.col("slot") == 2, F.col("n"))).alias("about"),
        F.sum(F.when(is_word, F.when(c > 0, F.col("n"))).when(F.col("slot") == 3, F.col("n"))).alias("n_known"),
        F.sum(F.when(is_word, F.col("n") * F.log10(c + 1)).when(F.col("slot") == 1, F.col("x"))).alias("base"),
        F.sum(F.when(is_word, chance).when(F.col("slot") == 2, F.col("x"))).alias("score"))
    n_tokens = F.floor(F.col("about") / 2)
    return per.select(
        "doc_id", (F.col("about") % 2 == 1).alias("held_out"), n_tokens.alias("n_tokens"),
        (F.coalesce("n_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.log10(F.lit(float(ends + 1))) - n_tokens * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        "score")
