"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +-1. A trigram binds the vectors of its
letters, permuted by their place, with an element-wise product; a text bundles
the vectors of its trigrams, weighted by the root of their counts, into one
sum; a language is the sum of its learning texts. A text gets the language whose
prototype has the largest cosine with its vector. Both are taken relative to the
mean prototype, which removes what all languages share.

Letter vectors follow from the code point, so no alphabet is fixed, and the
prototypes are all that a model holds: languages x dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN = "und"
#: characters of text worked on at once
SLICE_CHARS = 1_500_000


@dataclass(frozen=True)
class HyperSettings:
    dimensions: int = 512
    seed: int = 977


class TrigramVectors:
    """Trigram vectors of the letters met so far."""

    def __init__(self, settings: HyperSettings):
        self.settings, self._known = settings, {}

    def _letters(self, points: np.ndarray) -> np.ndarray:
        out = np.empty((len(points), self.settings.dimensions), dtype=np.int8)
        for i, point in enumerate(points.tolist()):
            vector = self._known.get(point)
            if vector is None:
                rng = np.random.default_rng([self.settings.seed, point])
                vector = self._known[point] = rng.integers(0, 2, self.settings.dimensions, dtype=np.int8) * 2 - 1
            out[i] = vector
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Trigrams of texts: text number, number of its vector, count; and the vectors.

        A word's trigrams include those with the gap before and behind it.
        """
        joined = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(joined)]
        joined, text = np.append(np.uint32(10), np.append(joined, np.uint32(10))), np.concatenate(([0], text, text[-1:]))
        present = np.flatnonzero(np.bincount(joined))
        letters = np.array([c for c in present.tolist() if chr(c).isalpha()], dtype=np.int64)
        number = np.zeros(int(present[-1]) + 1, dtype=np.int64)
        number[letters] = np.arange(1, len(letters) + 1)
        at, base = number[joined], len(letters) + 1
        middle = np.flatnonzero(at[1:-1]) + 1
        code = (at[middle - 1] * base + at[middle]) * base + at[middle + 1]
        grams, which = np.unique(code, return_inverse=True)
        keys, n = np.unique(text[middle] * max(len(grams), 1) + which, return_counts=True)
        row, gram = np.divmod(keys, max(len(grams), 1))
        vectors = self._letters(np.append(10, letters))
        first, rest = np.divmod(grams, base * base)
        second, third = np.divmod(rest, base)
        bound = np.roll(vectors, 2, axis=1)[first] * np.roll(vectors, 1, axis=1)[second] * vectors[third]
        return row, gram, n, bound.astype(np.float32)


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    total = np.cumsum(pc.utf8_length(texts).to_numpy())
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + SLICE_CHARS, "right")))
        yield first, texts.slice(first, last - first).to_pylist()
        first = last
    pa.default_memory_pool().release_unused()


def learn(docs: DataFrame, settings: HyperSettings = HyperSettings()) -> dict[str, np.ndarray]:
    """Prototype of each language from ``docs`` (text, lang); null languages and null texts teach nothing."""

    def run(batches):
        grams, sums = TrigramVectors(settings), {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, texts in _slices(batch.column(0)):
                row, gram, n, vectors = grams.counts(texts)
                mine = langs[first : first + len(texts)]
                for lang in sorted(set(mine)):
                    of_lang = np.array([x == lang for x in mine])[row]
                    weight = np.bincount(gram[of_lang], np.sqrt(n[of_lang]), len(vectors))
                    sums[lang] = sums.get(lang, 0) + weight @ vectors
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(total)), "i": pa.array(np.arange(len(total), dtype=np.int32)),
                "x": pa.array(total.astype(np.float64))})

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(
        run, "lang string, i int, x double")
    table = rows.groupBy("lang", "i").agg(F.sum("x").alias("x")).toArrow()
    out: dict[str, np.ndarray] = {}
    for lang, i, x in zip(*(table.column(c).to_pylist() for c in ("lang", "i", "x"))):
        out.setdefault(lang, np.zeros(settings.dimensions))[i] = x
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(out.items()) if np.linalg.norm(v) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], settings: HyperSettings = HyperSettings()) -> DataFrame:
    """Add lang_pred and score (the cosine, from 0 to 1) to every row of ``docs``, whose column text is read.

    Text that is null or has no letter, and any text if no language was learnt,
    gets ``und`` and 0. Ties go to the first language in the order of names.
    Columns of those names in ``docs`` are replaced.
    """
    names = [*prototypes, UNKNOWN]
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index("text")
    matrix = np.array(list(prototypes.values())).reshape(len(prototypes), settings.dimensions)
    mean = matrix.mean(axis=0) if len(matrix) > 1 else np.zeros(settings.dimensions)
    apart = matrix - mean
    apart = (apart / np.linalg.norm(apart, axis=1, keepdims=True)).astype(np.float32) if len(matrix) else matrix

    def run(batches):
        grams = TrigramVectors(settings)
        for batch in batches:
            best, score = np.full(len(batch), len(names) - 1), np.zeros(len(batch))
            for first, texts in _slices(batch.column(at)) if len(apart) else ():
                row, gram, n, vectors = grams.counts(texts)
                weight = np.sqrt(n).astype(np.float32)
                bounds = np.searchsorted(row, np.arange(len(texts) + 1))
                for i in np.flatnonzero(np.diff(bounds)):
                    a, b = bounds[i], bounds[i + 1]
                    bundle = weight[a:b] @ vectors[gram[a:b]]
                    bundle /= np.linalg.norm(bundle) or 1.0
                    bundle = bundle - mean
                    cosine = apart @ bundle / (np.linalg.norm(bundle) or 1.0)
                    k = best[first + i] = int(np.argmax(cosine))
                    score[first + i] = min(max(float(cosine[k]), 0.0), 1.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([names[k] for k in best], pa.string()), pa.array(score)],
                names=[*kept, "lang_pred", "score"])

    fields = docs.select(*kept).schema
    return docs.select(*kept).mapInArrow(run, fields.add("lang_pred", "string").add("score", "double"))


def identify(docs: DataFrame, *, held_out: Column, settings: HyperSettings = HyperSettings()) -> DataFrame:
    """Predict the language of every text of ``docs`` (doc_id, text, lang), learning where ``held_out`` isn't true.

    One row per input row: doc_id, held_out, lang_pred, score. A null ``held_out``
    counts as learning. Other columns are ignored.
    """
    rows = docs.withColumn("__held_out", F.coalesce(held_out, F.lit(False)))
    prototypes = learn(rows.where(~F.col("__held_out")), settings)
    found = predict(rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("__held_out").alias("held_out"),
        F.col("text").cast("string").alias("text")), prototypes, settings)
    return found.drop("text")
