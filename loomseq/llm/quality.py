"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text falls into a bin of its own lookup table; the score is the
logistic function of the sum of the bins' values, over single features and a few
pairs. Tables are learnt by boosting in turn: for one feature after the other, a
shallow tree over its ordered bins is fitted to the current errors and a part of
it is added to the table. Pairs with the largest remaining gain follow the same way
on a coarse grid.

Features are computed over whole texts where they are read. Learning takes a
bounded sample of labelled rows to the driver (``sample`` of :func:`score_quality`,
the rows with the smallest hashes); scoring adds bins in arrays.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import smallest_hashes, written

#: bytes of text worked on at once
SLICE_BYTES = 6_000_000
FEATURES = (
    "log_words", "word_length", "distinct_words", "top_word", "same_as_before", "upper", "digit", "mark", "exclamation",
    "pipe", "symbol", "other_letter", "space", "line_words", "repeated_lines", "long_words", "bare_words")
_CLASSES = ("lower", "upper", "digit", "mark", "exclamation", "pipe", "symbol", "other_letter", "space", "newline")


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("symbol"), dtype=np.int64)
    for c in range(256):
        char = chr(c)
        if c >= 128:
            table[c] = _CLASSES.index("other_letter")
        elif char.isalpha():
            table[c] = _CLASSES.index("lower" if char.islower() else "upper")
        elif char.isdigit():
            table[c] = _CLASSES.index("digit")
        elif char == "\n":
            table[c] = _CLASSES.index("newline")
        elif char.isspace():
            table[c] = _CLASSES.index("space")
        elif char in ".,;:'\"()-?":
            table[c] = _CLASSES.index("mark")
        elif char in "!|":
            table[c] = _CLASSES.index("exclamation" if char == "!" else "pipe")
    return table


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _per_group(owner: np.ndarray, codes: np.ndarray, kinds: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each group, and how often its commonest one occurs."""
    keys, n = np.unique(owner * max(kinds, 1) + codes, return_counts=True)
    of = keys // max(kinds, 1)
    top = np.zeros(groups)
    np.maximum.at(top, of, n)
    return np.bincount(of, minlength=groups), top


def text_features(texts: pa.Array) -> np.ndarray:
    """Feature values of each text: (texts, features). Null and empty texts have zeros."""
    texts = pc.fill_null(texts, "").cast(pa.string())  # 64-bit offsets too: a slice is far below 2 GB
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    count = np.bincount(owner * len(_CLASSES) + _class_table()[raw], minlength=n * len(_CLASSES)).reshape(n, -1)
    of = {name: count[:, k] for k, name in enumerate(_CLASSES)}

    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    flat = words.flatten()
    in_word = np.repeat(np.arange(n), pc.list_value_length(words).to_numpy())
    length = pc.binary_length(flat).to_numpy()
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy()
    real = length > 0
    in_word, length, codes = in_word[real], length[real], codes[real]
    n_words = np.bincount(in_word, minlength=n)
    distinct, top = _per_group(in_word, codes, len(coded.dictionary), n)
    again = (codes[1:] == codes[:-1]) & (in_word[1:] == in_word[:-1])
    ends_bare = pc.match_substring_regex(coded.dictionary, "[a-z0-9\x80-\U0010ffff]$").to_numpy(zero_copy_only=False)
    lines = pc.split_pattern(texts, "\n")
    in_line = np.repeat(np.arange(n), pc.list_value_length(lines).to_numpy())
    line_codes = lines.flatten().dictionary_encode()
    n_lines = np.bincount(in_line, minlength=n)
    distinct_lines, _ = _per_group(in_line, line_codes.indices.to_numpy(), len(line_codes.dictionary), n)
    values = {
        "log_words": np.log1p(n_words), "word_length": _share(np.bincount(in_word, length, n), n_words),
        "distinct_words": _share(distinct, n_words), "top_word": _share(top, n_words),
        "same_as_before": _share(np.bincount(in_word[1:][again], minlength=n), n_words),
        "line_words": _share(n_words, n_lines), "repeated_lines": 1 - _share(distinct_lines, n_lines),
        "long_words": _share(np.bincount(in_word, length > 20, n), n_words),
        "bare_words": _share(np.bincount(in_word, ends_bare[codes], n), n_words),
    } | {name: _share(of[name], size) for name in (
        "upper", "digit", "mark", "exclamation", "pipe", "symbol", "other_letter", "space")}
    return np.stack([np.where(size > 0, values[name], 0.0) for name in FEATURES], axis=1)


# --- the model -------------------------------------------------------------------------------

def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Best cut of ordered bins, and its gain."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
    k = int(np.argmax(gain)) if len(gain) else 0
    return k + 1, float(gain[k]) if len(gain) else 0.0


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf value of each bin of a greedy tree."""
    cut, gain = _split(g, h)
    if not depth or gain <= 1e-9:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate((_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)))


def _tree2(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """The same over a grid: each cut is along the better axis."""
    (row, by_row), (col, by_col) = _split(g.sum(1), h.sum(1)), _split(g.sum(0), h.sum(0))
    if not depth or max(by_row, by_col) <= 1e-9:
        return np.full(g.shape, _leaf(g.sum(), h.sum()))
    if by_row >= by_col:
        return np.concatenate((_tree2(g[:row], h[:row], depth - 1), _tree2(g[row:], h[row:], depth - 1)))
    return np.concatenate((_tree2(g[:, :col], h[:, :col], depth - 1), _tree2(g[:, col:], h[:, col:], depth - 1)), axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AdditiveModel:
    """Intercept, bin borders, a table per feature, and tables of feature pairs on coarse bins."""

    def __init__(self, intercept: float, edges: list[np.ndarray], tables: list[np.ndarray],
                 coarse: list[np.ndarray], pairs: dict[tuple[int, int], np.ndarray]):
        self.intercept, self.edges, self.tables, self.coarse, self.pairs = intercept, edges, tables, coarse, pairs

    @classmethod
    def fitted(cls, x: np.ndarray, y: np.ndarray, *, bins: int = 48, coarse_bins: int = 8, rounds: int = 150,
               pair_rounds: int = 60, n_pairs: int = 8, rate: float = 0.15, depth: int = 2) -> AdditiveModel:
        """Learn from features ``x`` and labels ``y`` (0 or 1); the same rows in any order give the same model up to rounding."""
        width = x.shape[1]
        borders = lambda k: [np.unique(np.quantile(x[:, f], np.linspace(0, 1, k + 1)[1:-1])) if len(x) else np.zeros(0)
                             for f in range(width)]
        edges, coarse = borders(bins), borders(coarse_bins)
        ones = float(y.sum())
        intercept = float(np.log((ones + 1) / (len(y) - ones + 1)))
        tables = [np.zeros(len(e) + 1) for e in edges]
        pairs: dict[tuple[int, int], np.ndarray] = {}
        if not 0 < ones < len(y):
            return cls(intercept, edges, tables, coarse, pairs)
        at = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]
        total = np.full(len(y), intercept)
        for _ in range(rounds):
            for f in range(width):
                p = _sigmoid(total)
                g = np.bincount(at[f], y - p, len(tables[f]))
                h = np.bincount(at[f], p * (1 - p), len(tables[f]))
                step = rate * _tree(g, h, depth)
                tables[f] += step
                total += step[at[f]]
        rough = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(coarse)]

        def grid(a, b):
            shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
            cell = rough[a] * shape[1] + rough[b]
            p = _sigmoid(total)
            size = shape[0] * shape[1]
            return cell, np.bincount(cell, y - p, size).reshape(shape), np.bincount(cell, p * (1 - p), size).reshape(shape)

        def strength(pair):
            _, g, h = grid(*pair)
            return float((g**2 / (h + 1)).sum() - (g.sum(1) ** 2 / (h.sum(1) + 1)).sum() - (g.sum(0) ** 2 / (h.sum(0) + 1)).sum())

        chosen = sorted(combinations(range(width), 2), key=lambda p: (-strength(p), p))[:n_pairs]
        pairs = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
        for _ in range(pair_rounds):
            for pair, table in pairs.items():
                cell, g, h = grid(*pair)
                step = rate * _tree2(g, h, depth + 1)
                table += step
                total += step.reshape(-1)[cell]
        return cls(intercept, edges, tables, coarse, pairs)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="left")]
        for (a, b), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="left"), np.searchsorted(self.coarse[b], x[:, b], side="left")]
        return _sigmoid(total)


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, features) of ``docs`` (doc_id, held_out, text)."""

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(2), "")
            total = np.cumsum(pc.binary_length(texts).to_numpy())
            first = 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + SLICE_BYTES, "right")))
                values = text_features(texts.slice(first, last - first))
                ends = np.arange(0, values.size + 1, len(FEATURES), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1)))],
                    names=["doc_id", "held_out", "features"])
                first = last

    return docs.mapInArrow(run, "doc_id long, held_out boolean, features array<double>")


def score_quality(docs: DataFrame, labels: DataFrame, *, held_out: Column, threshold: float = 0.7, sample: int = 20_000) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text), learning from ``labels`` (doc_id, quality) where ``held_out`` isn't true.

    One row per input row: doc_id, held_out, score (probability of label 1),
    predicted (1 if score >= threshold). At most ``sample`` labelled rows are learnt
    from. Null and empty texts are scored like others, with zero features. Labels that
    are null or of unknown documents teach nothing; a null ``held_out`` counts as
    learning. Without both labels every score is the smoothed share of label 1.
    Repeated rows each get their row; other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"))
    table = written(featured(rows), "features")
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("y IN (0, 1)")
    learn = table.where("NOT held_out").join(known, "doc_id").select("doc_id", "features", "y")
    learn = smallest_hashes(learn.withColumn("h", F.xxhash64("doc_id")), "h", sample)
    learn = learn.orderBy("h", "doc_id", "y").limit(sample).drop("h").toArrow()
    x = learn.column("features").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    model = AdditiveModel.fitted(x, learn.column("y").to_numpy())
    parts = model.intercept, model.edges, model.tables, model.coarse, model.pairs

    def run(batches):
        scorer = AdditiveModel(*parts)
        for batch in batches:
            values = batch.column(2).flatten().to_numpy().reshape(-1, len(FEATURES))
            score = scorer.scores(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return table.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
