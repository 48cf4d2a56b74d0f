"""Hierarchical packing of token sequences into windows of several lengths.

Documents are tokenised, cut into full windows of the largest context size and
one rest; each rest goes to the tier of the smallest power of two that holds it.
Tiers are packed from the largest down: every rest opens a window of its tier,
and the gap behind it is filled from the shorter tiers, whole rests first
(largest that fits), then one rest cut to measure. What is left of a partition
in the end is cut into windows of descending powers of two, so that no window
needs padding.

All of it happens where the documents are read: no ids are shuffled, a task
holds the ids of one slice of texts, and the carried rest is under one window.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: id that ends every document
END_ID = 1
#: bytes of text whose distinct words are encoded together, and of which ids are made and packed at once
WORDS_BYTES, IDS_BYTES = 16_000_000, 4_000_000
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, context bigint, step_group bigint")
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts, each distinct word encoded once per call.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its white-space separated words. Words made of Latin-1
    letters with at most a tail of ASCII marks share the ids of their letters;
    letters are encoded many at a time, and the word-end mark of the vocabulary
    tells where one ends.
    """

    #: stem and tail of the words that share ids with their letters
    _plain = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"

    def __init__(self, path: str, group: int = 500):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.group = Tokenizer.from_file(path), group
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _each(self, texts: list[str], at_once: int = 10_000) -> Iterator[list[int]]:
        # encodings hold much more than the ids: a few at a time
        for k in range(0, len(texts), at_once):
            for e in self.tokenizer.encode_batch_fast(texts[k : k + at_once], add_special_tokens=False):
                yield e.ids

    def _lists(self, texts: list[str]) -> Lists:
        return Lists.of(list(self._each(texts)))

    def _letters(self, pieces: list[str]) -> Lists:
        groups = [pieces[i : i + self.group] for i in range(0, len(pieces), self.group)]
        done = []
        for group, ids in zip(groups, self._each([" ".join(g) for g in groups], 20), strict=True):
            flat = np.array(ids, dtype=np.uint32)
            cuts = np.flatnonzero(self.ends[flat]) + 1
            whole = len(cuts) == len(group) and cuts[-1] == len(flat)
            done.append(Lists(flat, np.diff(cuts, prepend=0)) if whole else self._lists(group))
        return Lists.joined(done)

    def _words(self, distinct: pa.Array) -> Lists:
        """Ids of distinct words, and of the end of a document behind them."""
        found = pc.extract_regex(distinct, self._plain)
        plain = pc.is_valid(found).to_numpy(zero_copy_only=False)
        found = found.drop_null()
        stems = pc.utf8_lower(pc.struct_field(found, "stem")).dictionary_encode()
        tails = pc.struct_field(found, "tail").dictionary_encode()
        tables = (self._letters(stems.dictionary.to_pylist()), self._lists(tails.dictionary.to_pylist()),
                  self._lists(distinct.filter(pa.array(~plain)).to_pylist()), Lists.of([[END_ID], []]))
        first = np.cumsum([0] + [len(t.sizes) for t in tables])
        parts = np.full((len(plain) + 1, 2), first[3] + 1)  # nothing
        parts[:-1][plain, 0] = first[0] + stems.indices.to_numpy()
        parts[:-1][plain, 1] = first[1] + tails.indices.to_numpy()
        parts[:-1][~plain, 0] = first[2] + np.arange(len(tables[2].sizes))
        parts[-1, 0] = first[3]
        table = Lists.joined(tables)
        return Lists(table.take(parts.ravel()), table.sizes[parts].sum(axis=1))

    def encode(self, texts: pa.Array) -> EncodedTexts:
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = self._words(coded.dictionary)
        ends = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
        codes = np.insert(coded.indices.to_numpy(), ends, len(words.sizes) - 1)
        return EncodedTexts(words, codes, np.append(0, ends + np.arange(1, len(ends) + 1)))


class Lists:
    """Lists of ids behind each other."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes
        self.begin = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, lists: list[list[int]]) -> Lists:
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return cls(np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(sizes.sum())), sizes)

    @classmethod
    def joined(cls, parts: Iterable[Lists]) -> Lists:
        parts = [cls.of([]), *parts]
        return cls(np.concatenate([p.flat for p in parts]), np.concatenate([p.sizes for p in parts]))

    def take(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the lists of these numbers."""
        taken = self.sizes[numbers]
        total = np.cumsum(taken)
        return self.flat[np.repeat(self.begin[numbers] - (total - taken), taken) + np.arange(taken.sum())]


class EncodedTexts:
    """Texts as word numbers, each ended by that of ``END_ID``, with the ids of every distinct word."""

    def __init__(self, words: Lists, codes: np.ndarray, bounds: np.ndarray):
        self.words, self.codes, self.bounds = words, codes, bounds

    def ids(self, first: int, last: int) -> list[np.ndarray]:
        """Ids of the texts from ``first`` up to ``last``."""
        codes = self.codes[self.bounds[first] : self.bounds[last]]
        ends = np.cumsum(self.words.sizes[codes])[self.bounds[first + 1 : last + 1] - self.bounds[first] - 1]
        return np.split(self.words.take(codes), ends[:-1])


def _runs(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``size`` bytes."""
    total = np.cumsum(pc.binary_length(texts).to_numpy())
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + size, side="right")))
        yield first, last
        first = last


class Piece:
    """A run of one document's ids."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, ids: np.ndarray, start: int, total: int):
        self.doc, self.ids, self.start, self.total = doc, ids, start, total

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.ids[:length], self.start, self.total),
                Piece(self.doc, self.ids[length:], self.start + length, self.total))


class TierPacker:
    """Packs pieces into windows; what can't fill its window stays for the next call."""

    def __init__(self, context: int):
        if context < 1 or context & (context - 1):
            raise ValueError("the context size must be a power of two")
        self.context = context
        self.left: list[Piece] = []

    def pack(self, docs: list[Piece]) -> Iterator[list[Piece]]:
        """Full windows of any tier; each is a list of pieces."""
        queue = self.left
        for doc in docs:
            while len(doc.ids) >= self.context:
                window, doc = doc.cut(self.context)
                yield [window]
            if len(doc.ids):
                queue.append(doc)
        queue.sort(key=lambda p: len(p.ids))
        sizes = [len(p.ids) for p in queue]
        tier, self.left = self.context, []
        while queue:
            while tier // 2 >= sizes[-1]:
                tier //= 2
            window, gap = [queue.pop()], tier - sizes.pop()
            while gap and queue:
                fits = bisect_right(sizes, gap) - 1
                if fits >= 0:
                    sizes.pop(fits)
                    window.append(queue.pop(fits))
                else:  # the shortest is longer than the gap: cut it to measure
                    sizes.pop(0)
                    head, rest = queue.pop(0).cut(gap)
                    window.append(head)
                    at = bisect_left(sizes, len(rest.ids))
                    sizes.insert(at, len(rest.ids))
                    queue.insert(at, rest)
                gap -= len(window[-1].ids)
            if gap:
                self.left = [Piece(p.doc, p.ids.copy(), p.start, p.total) for p in window]
            else:
                yield window

    def finish(self) -> Iterator[list[Piece]]:
        """The rest, under one window, in windows of descending powers of two."""
        queue, self.left = self.left[::-1], []
        total = sum(len(p.ids) for p in queue)
        while total:
            size = 1 << (total.bit_length() - 1)
            window, gap = [], size
            while gap:
                head, rest = queue.pop().cut(gap)
                window.append(head)
                gap -= len(head.ids)
                if len(rest.ids):
                    queue.append(rest)
            total -= size
            yield window


def step_groups(windows: list[list[Piece]], per_step: int) -> list[int]:
    """A group number for each window: windows of one length, dealt by attention cost.

    The dearest windows go to different groups in turn, forth and back, so that
    the sums of squared piece lengths differ little between groups.
    """
    by_size: dict[int, list[int]] = {}
    for i, window in enumerate(windows):
        by_size.setdefault(sum(len(p.ids) for p in window), []).append(i)
    group, first = [0] * len(windows), 0
    for size in sorted(by_size, reverse=True):
        mine = sorted(by_size[size], key=lambda i: -sum(len(p.ids) ** 2 for p in windows[i]))
        n = -(-len(mine) // per_step)
        for k, i in enumerate(mine):
            turn, at = divmod(k, n)
            group[i] = first + (n - 1 - at if turn % 2 else at)
        first += n
    return group


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, context: int = 2048, per_step: int = 8) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into windows; one row per piece (see ``SCHEMA``).

    ``start`` counts the document's ids before the piece, ``offset`` those of the
    window before it, ``context`` is the window's length, ``step_group`` a group of up
    to ``per_step`` windows of one length with balanced cost. ``sequence_id`` and
    ``step_group`` carry the partition in their upper bits. Null text is empty and
    gives the end id alone; a null doc_id stays null; repeated rows are documents of
    their own; an empty table gives no row; other columns are ignored.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        encoder, packer = WordEncoder(path), TierPacker(context)
        upper = TaskContext.get().partitionId() << 40
        sequence = groups = 0

        def rows(windows):
            nonlocal sequence, groups
            numbers = step_groups(windows, per_step)
            out: list[list] = [[] for _ in _COLUMNS]
            for window, number in zip(windows, numbers, strict=True):
                offset, size = 0, sum(len(p.ids) for p in window)
                for p in window:
                    crc = zlib.crc32(np.ascontiguousarray(p.ids, dtype="<u4"))
                    for column, value in zip(out, (
                            p.doc, p.start, len(p.ids), crc, p.total, upper + sequence, offset, size,
                            upper + groups + number)):
                        column.append(value)
                    offset += len(p.ids)
                sequence += 1
            groups += max(numbers, default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=_COLUMNS)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = pc.fill_null(batch.column(1), "")
            for begin, end in _runs(texts, WORDS_BYTES):
                part = texts.slice(begin, end - begin)
                encoded = encoder.encode(part)
                for first, last in _runs(part, IDS_BYTES):
                    docs = [Piece(d, x, 0, len(x)) for d, x in zip(ids[begin + first : begin + last], encoded.ids(first, last), strict=True)]
                    yield rows(list(packer.pack(docs)))
                pa.default_memory_pool().release_unused()
        yield rows(list(packer.finish()))

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, SCHEMA)
