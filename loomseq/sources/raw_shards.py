"""Raw shard files: ``shard_NNNNN.bin`` (little-endian uint32) and ``shard_NNNNN.idx`` (JSON), as the data source ``raw_shards``.

Batch reads take the byte ranges of chosen shards and documents by the index files,
streams read shards as they arrive, writes appear when the whole job commits. Paths
are those of ``pyarrow.fs``: folders mounted on all machines, or object stores.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage)

from ..schemas import SHARD_INDEX, SHARD_MANIFEST
from ..session import new_folder

#: bytes of raw tokens a read task takes on at most and at least, and tokens per record batch
BYTES_PER_TASK, LEAST_BYTES = 128 * 2**20, 2**20
TOKENS_PER_BATCH = 2**20
#: largest id of a file, plus one
IDS = 2**32


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path, and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def shard_number(name: str) -> int | None:
    """Number in a file name ``shard_<digits>.<kind>``."""
    stem = name.rsplit(".", 1)[0]
    digits = stem.removeprefix("shard_")
    return int(digits) if stem.startswith("shard_") and digits.isdigit() else None


def list_shards(path: str) -> dict[int, tuple[str, int]]:
    """Number -> (stem, bytes) of the shards that have both files."""
    store, root = open_store(path)
    found: dict[str, dict[int, tuple[str, int]]] = {"bin": {}, "idx": {}}
    for entry in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        number, kind = shard_number(entry.base_name), entry.extension
        if number is not None and kind in found:
            found[kind][number] = (entry.base_name.rsplit(".", 1)[0], entry.size)
    return {n: s for n, s in sorted(found["bin"].items()) if n in found["idx"]}


# --- discovery ---------------------------------------------------------------------------------

def discover_shards(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """``(shard_idx, stem, bin_path, idx_path)`` in shard order; file contents are not read.

    A shard without its partner is an error, or a row with a null path if not ``strict``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard_*").load(path).select("path")
    stem = F.regexp_extract("path", r"(shard_\d+)\.(bin|idx)$", 1)
    kind = F.regexp_extract("path", r"(shard_\d+)\.(bin|idx)$", 2)
    files = files.select("path", stem.alias("stem"), kind.alias("kind")).where(F.col("kind") != "")
    side = lambda k: files.where(F.col("kind") == k).select("stem", F.col("path").alias(f"{k}_path"))
    pairs = side("bin").join(side("idx"), "stem", "full_outer")
    if strict:
        if pairs.isEmpty():
            raise FileNotFoundError(f"no shards in {path}")
        whole = F.col("bin_path").isNotNull() & F.col("idx_path").isNotNull()
        # part of the filter, so that no plan can leave the check out
        pairs = pairs.where(F.when(whole, True).otherwise(
            F.raise_error(F.concat(F.lit("shard file without its partner: "), F.col("stem"))).cast("boolean")))
    number = F.regexp_extract("stem", r"(\d+)$", 1).cast("bigint")
    return pairs.select(number.alias("shard_idx"), "stem", "bin_path", "idx_path").orderBy("shard_idx")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of a raw shard folder."""
    rows = spark.read.schema(SHARD_INDEX).option("multiLine", True).option("pathGlobFilter", "shard_*.idx").json(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"shard_(\d+)\.idx$", 1).cast("bigint")
    return rows.select(number.alias("shard_idx"), "documents", "num_tokens", "metadata")


# --- reading -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Slice:
    """One of ``of`` equal parts of a shard, by tokens."""

    number: int
    stem: str
    part: int = 0
    of: int = 1


class ShardPartition(InputPartition):
    def __init__(self, slices: list[Slice]):
        self.slices = slices


def deal_slices(shards: dict[int, tuple[str, int]], tasks: int) -> list[ShardPartition]:
    """Shards in order, gathered or sliced so that about ``tasks`` tasks read alike; only names and sizes are known here."""
    total = sum(size for _, size in shards.values())
    target = min(max(total // max(tasks, 1), LEAST_BYTES), BYTES_PER_TASK)
    parts: list[ShardPartition] = []
    gathered: list[Slice] = []
    held = 0
    for number, (stem, size) in shards.items():
        if gathered and held + size > target:
            parts.append(ShardPartition(gathered))
            gathered, held = [], 0
        if size > target:
            of = -(-size // target)
            parts += [ShardPartition([Slice(number, stem, i, of)]) for i in range(of)]
        else:
            gathered.append(Slice(number, stem))
            held += size
    return parts + [ShardPartition(gathered)] if gathered else parts


def read_documents(path: str, piece: Slice, documents: range | None = None) -> Iterator[pa.RecordBatch]:
    """Documents of a slice of a shard, about ``TOKENS_PER_BATCH`` tokens a batch; adjacent ones are read at once."""
    store, root = open_store(path)
    with store.open_input_stream(f"{root}/{piece.stem}.idx") as f:
        spans = np.array([(d["start"], d["end"]) for d in json.loads(f.read())["documents"]], dtype=np.int64).reshape(-1, 2)
    chosen = np.ones(len(spans), dtype=bool)
    if documents is not None:
        chosen[:documents.start] = chosen[documents.stop:] = False
    if piece.of > 1:
        share = spans[:, 0] * piece.of // max(int(spans[:, 1].max(initial=1)), 1)
        chosen &= np.minimum(share, piece.of - 1) == piece.part
    chosen = np.flatnonzero(chosen)
    if not len(chosen):
        return
    lengths = spans[chosen, 1] - spans[chosen, 0]
    with store.open_input_file(f"{root}/{piece.stem}.bin") as f:
        for lo, hi in runs_of((np.cumsum(lengths) - 1) // TOKENS_PER_BATCH):
            at, start, end = chosen[lo:hi], spans[chosen[lo:hi], 0], spans[chosen[lo:hi], 1]
            apart = np.cumsum(np.concatenate(([0], start[1:] != end[:-1])))
            raw = [f.read_at(int(end[b - 1] - start[a]) * 4, int(start[a]) * 4) for a, b in runs_of(apart)]
            values = np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int64)
            if len(values) != int((end - start).sum()):
                raise ValueError(f"{piece.stem}.bin ends before its index")
            offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "shard_idx": pa.array(np.full(len(at), piece.number), pa.int64()), "doc_ix": pa.array(at, pa.int64()),
                "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64()),
                "tokens": pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64()))})


def runs_of(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Half-open index ranges of equal neighbours."""
    if len(values):
        edges = np.concatenate(([0], np.flatnonzero(np.diff(values)) + 1, [len(values)]))
        yield from zip(edges[:-1].tolist(), edges[1:].tolist())


class RawShardReader(DataSourceReader):
    """Chosen shards, and of these a range of documents; nothing else is opened or read.

    The choice is part of the read. Filters that Spark pushes into a Python data
    source are kept with the relation, so two scans of one DataFrame in a plan
    would both get the filters of one of them.
    """

    def __init__(self, path: str, tasks: int, shards: frozenset[int] | None = None, documents: range | None = None):
        self.path, self.tasks, self.shards, self.documents = path, tasks, shards, documents

    def partitions(self) -> list[ShardPartition]:
        shards = list_shards(self.path)
        if not shards:
            raise FileNotFoundError(f"no shards in {self.path}")
        chosen = {n: s for n, s in shards.items() if self.shards is None or n in self.shards}
        return deal_slices(chosen, self.tasks) or [ShardPartition([])]

    def read(self, partition: ShardPartition) -> Iterator[pa.RecordBatch]:
        for piece in partition.slices:
            yield from read_documents(self.path, piece, self.documents)


class RawShardStream(DataSourceStreamReader):
    """Shards in the order of their numbers, from ``first`` on; the offset is the next number.

    A shard is taken once both its files and all shards before it are there, so an
    offset stands for the same shards whenever it is read again.
    """

    def __init__(self, path: str, tasks: int, first: int):
        self.path, self.tasks, self.first = path, tasks, first

    def initialOffset(self) -> dict:
        return {"next": self.first}

    def latestOffset(self) -> dict:
        shards, end = list_shards(self.path), self.first
        while end in shards:
            end += 1
        return {"next": end}

    def partitions(self, start: dict, end: dict) -> list[ShardPartition]:
        shards = list_shards(self.path)
        return deal_slices({n: shards[n] for n in range(start["next"], end["next"])}, self.tasks)

    def read(self, partition: ShardPartition) -> Iterator[pa.RecordBatch]:
        for piece in partition.slices:
            yield from read_documents(self.path, piece)


# --- writing -----------------------------------------------------------------------------------

@dataclass
class ShardsWritten(WriterCommitMessage):
    """Files a task has finished: (shard_idx, documents, num_tokens, name of its files without kind)."""

    shards: list[tuple[int, int, int, str]]


def shard_stem(number: int) -> str:
    return f"shard_{number:05d}"


class _OpenShard:
    """One shard being written below the job's folder."""

    def __init__(self, store: fs.FileSystem, folder: str, number: int, attempt: int):
        self.store, self.number = store, number
        self.name = f"{folder}/{shard_stem(number)}.{attempt}"
        self.file = store.open_output_stream(f"{self.name}.bin")
        self.lengths: list[np.ndarray] = []
        self.last = -1

    def add(self, doc_ix: np.ndarray, tokens: pa.ListArray) -> None:
        if doc_ix[0] <= self.last or (np.diff(doc_ix) <= 0).any():
            raise ValueError(f"documents of shard {self.number} must come in order, once each")
        self.last = int(doc_ix[-1])
        ids = tokens.flatten().to_numpy(zero_copy_only=False)
        if len(ids) and (ids.min() < 0 or ids.max() >= IDS):
            raise ValueError(f"token id of shard {self.number} does not fit 32 bits")
        self.file.write(ids.astype("<u4").tobytes())
        self.lengths.append(tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))

    def close(self, metadata: dict[str, str]) -> tuple[int, int, int, str]:
        self.file.close()
        ends = np.cumsum(np.concatenate(self.lengths))
        documents = [{"start": s, "end": e} for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]
        with self.store.open_output_stream(f"{self.name}.idx") as f:
            f.write(json.dumps({"documents": documents, "num_tokens": int(ends[-1]), "metadata": metadata}).encode())
        return self.number, len(ends), int(ends[-1]), self.name


class RawShardWriter(DataSourceArrowWriter):
    """Writes (shard_idx, doc_ix, tokens), dealt by shard and ordered within it.

    Tasks write below a folder of the job; ``commit`` moves the files of the tasks
    that succeeded to their names, ``abort`` removes the folder. So a failing job
    leaves nothing that a reader sees, and a task that ran twice counts once.
    """

    def __init__(self, path: str, metadata: dict[str, str], manifest: str | None, overwrite: bool):
        self.path, self.metadata, self.manifest, self.overwrite = path, metadata, manifest, overwrite
        self.job = uuid.uuid4().hex

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        store, root = open_store(self.path)
        return store, root, f"{root}/_writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> ShardsWritten:
        from pyspark import TaskContext

        store, _, folder = self._folder()
        attempt = TaskContext.get().taskAttemptId()
        done: list[tuple[int, int, int, str]] = []
        current = None
        for batch in iterator:
            shards = batch.column("shard_idx").to_numpy()
            if current is None and batch.num_rows:
                store.create_dir(folder, recursive=True)
            for lo, hi in runs_of(shards):
                if current is None or current.number != int(shards[lo]):
                    done += [current.close(self.metadata)] if current else []
                    current = _OpenShard(store, folder, int(shards[lo]), attempt)
                current.add(batch.column("doc_ix").to_numpy()[lo:hi], batch.column("tokens").slice(lo, hi - lo))
        done += [current.close(self.metadata)] if current else []
        return ShardsWritten(done)

    def commit(self, messages: list[ShardsWritten]) -> None:
        store, root, folder = self._folder()
        done = sorted(s for m in messages if m is not None for s in m.shards)
        numbers = [s[0] for s in done]
        if len(set(numbers)) < len(numbers):
            raise ValueError("rows of one shard came from several tasks; deal them by shard_idx")
        store.create_dir(root, recursive=True)
        there = {n: e for e in store.get_file_info(fs.FileSelector(root)) if (n := shard_number(e.base_name)) is not None}
        if not self.overwrite and (again := sorted(set(there) & set(numbers))):
            raise FileExistsError(f"shards {again[:3]} are there already")
        # the index of a shard comes last: a shard without it is not read
        for kind in ("bin", "idx"):
            for number, _, _, name in done:
                store.move(f"{name}.{kind}", f"{root}/{shard_stem(number)}.{kind}")
        if self.overwrite:
            for number in set(there) - set(numbers):
                for entry in store.get_file_info([f"{root}/{shard_stem(number)}.{k}" for k in ("idx", "bin")]):
                    if entry.type == fs.FileType.File:
                        store.delete_file(entry.path)
        self._clear(store, folder)
        if self.manifest is not None:
            keep, at = open_store(self.manifest)
            keep.create_dir(at, recursive=True)
            with keep.open_output_stream(f"{at}/{self.job}.json") as f:
                for number, documents, tokens, _ in done:
                    row = {"shard_idx": number, "stem": shard_stem(number), "documents": documents, "num_tokens": tokens}
                    f.write(json.dumps(row).encode() + b"\n")

    def abort(self, messages: list[ShardsWritten]) -> None:
        store, _, folder = self._folder()
        self._clear(store, folder)

    @staticmethod
    def _clear(store: fs.FileSystem, folder: str) -> None:
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


# --- the data source ---------------------------------------------------------------------------

class RawShardSource(DataSource):
    """``raw_shards``: one row per document, ids as bigint.

    Options: ``tasks`` (about how many tasks read), ``shards`` (JSON list of numbers), ``documents``
    (JSON pair, half-open range of places in a shard), ``first`` (first shard of a stream), ``metadata``
    (JSON, for writes), ``manifest`` (folder for a list of the shards written).
    """

    @classmethod
    def name(cls) -> str:
        return "raw_shards"

    def schema(self) -> str:
        return "shard_idx bigint, doc_ix bigint, start bigint, end bigint, tokens array<bigint>"

    def _tasks(self) -> int:
        return int(self.options.get("tasks", 64))

    def reader(self, schema) -> DataSourceReader:
        shards, documents = (json.loads(self.options.get(name, "null")) for name in ("shards", "documents"))
        return RawShardReader(
            self.options["path"], self._tasks(), None if shards is None else frozenset(shards), None if documents is None else range(*documents))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RawShardStream(self.options["path"], self._tasks(), int(self.options.get("first", 0)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RawShardWriter(
            self.options["path"], json.loads(self.options.get("metadata", "{}")), self.options.get("manifest"), overwrite)


def read_raw_shards(
    spark: SparkSession, path: str, *, shards: Iterable[int] | None = None, documents: tuple[int, int] | None = None,
) -> DataFrame:
    """Documents of a raw shard folder, or those of some shards, or those at some places (half-open) of each shard."""
    spark.dataSource.register(RawShardSource)
    reader = spark.read.format("raw_shards").option("tasks", 2 * spark.sparkContext.defaultParallelism)
    if shards is not None:
        reader = reader.option("shards", json.dumps(sorted(shards)))
    if documents is not None:
        reader = reader.option("documents", json.dumps([max(0, documents[0]), max(0, *documents)]))
    return reader.load(path)


def stream_raw_shards(spark: SparkSession, path: str, *, first: int = 0) -> DataFrame:
    """The same documents as shards arrive."""
    spark.dataSource.register(RawShardSource)
    reader = spark.readStream.format("raw_shards").option("first", first)
    return reader.option("tasks", 2 * spark.sparkContext.defaultParallelism).load(path)


def write_raw_shards(rows: DataFrame, path: str, metadata: dict[str, str], *, manifest: str | None = None, mode: str = "append") -> None:
    """Write ``(shard_idx, doc_ix, tokens)`` as raw shard files; empty documents are left out.

    Each task streams its shards in order and holds one record batch at a time.
    """
    rows.sparkSession.dataSource.register(RawShardSource)
    filled = rows.where(F.size("tokens") > 0).select("shard_idx", "doc_ix", "tokens")
    ordered = filled.repartition("shard_idx").sortWithinPartitions("shard_idx", "doc_ix")
    writer = ordered.write.format("raw_shards").mode(mode).option("metadata", json.dumps(metadata))
    (writer.option("manifest", manifest) if manifest else writer).save(path)


def export_raw_shards(rows: DataFrame, path: str, metadata: dict[str, str], *, mode: str = "append") -> DataFrame:
    """Write raw shard files and give the manifest of what the tasks wrote."""
    spark = rows.sparkSession
    manifest = new_folder(spark, "manifest")
    write_raw_shards(rows, path, metadata, manifest=manifest, mode=mode)
    return spark.read.schema(SHARD_MANIFEST).json(manifest)
