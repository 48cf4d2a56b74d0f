"""Streams that break off, and raw shards as a data source."""

import os
import random

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import Row
from pyspark.sql import functions as F

import plain
from loomseq import schemas
from loomseq.operators import sharding as S
from loomseq.sources import batch_ledger, metric_sink, raw_shards
from loomseq.streaming import jobs as J
from loomseq.streaming import packing as Q

SHAPE = "epoch int, shard_idx bigint, rank int, turn bigint, doc_id bigint, len bigint, arrived timestamp"


# --- the ledger ---

def test_ledger(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("r", 1, "loss", 2.0), ("q", 1, "loss", 3.0)], schemas.METRICS)
    assert metric_sink.read_logged(spark, path).count() == 0
    assert metric_sink.log_batch(rows, path, "a", 0) and not metric_sink.log_batch(rows, path, "a", 0)
    assert metric_sink.log_batch(rows, path, "b", 0) and metric_sink.log_batch(rows.limit(0), path, "a", 1)
    # rows of a batch that broke off before it was entered are not seen, and replaced when it is replayed
    rows.write.partitionBy("run_id").parquet(f"{path}/rows/writer=a/batch_id=2")
    assert metric_sink.read_logged(spark, path).count() == 4 and metric_sink.read_logged(spark, path, "q").count() == 2
    assert metric_sink.log_batch(rows.where("run_id = 'q'"), path, "a", 2)
    assert metric_sink.read_logged(spark, path).count() == 5
    ledger = {(r.writer, r.batch_id): r["rows"] for r in batch_ledger.committed_batches(spark, path).collect()}
    assert ledger == {("a", 0): 2, ("b", 0): 2, ("a", 1): 0, ("a", 2): 1}


def broken_off(each, after):
    """``each``, failing once before (0) or after (1) it has written batch 1."""
    failed = []

    def run(rows, batch_id):
        if after == 1 or batch_id != 1 or failed:
            each(rows, batch_id)
        if batch_id == 1 and not failed:
            failed.append(1)
            raise RuntimeError("broken off")

    return run


@pytest.mark.parametrize("after", [0, 1])
def test_replayed_metric_batches(spark, tmp_path, after):
    rows = [("r", s, "loss", float(s)) for s in range(60)]
    for part in range(4):
        spark.createDataFrame(rows[part::4], schemas.METRICS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schemas.METRICS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    each = broken_off(lambda batch, n: metric_sink.log_batch(batch, str(tmp_path / "out"), "m", n), after)
    start = lambda: J.start_batches(stream, each, str(tmp_path / "state")).awaitTermination()
    with pytest.raises(StreamingQueryException):
        start()
    start()
    got = metric_sink.read_logged(spark, str(tmp_path / "out")).orderBy("step").collect()
    assert [(r.run_id, r.step, r.metric, r.value) for r in got] == rows


# --- packing with an end ---

def deal(seed, count=160):
    rng = random.Random(seed)
    rows, turn = [], {}
    for doc in range(count):
        key = (0, rng.randrange(2), rng.randrange(2))
        turn[key] = turn.get(key, -1) + 1
        rows.append((*key, turn[key], doc, rng.choice([0, 1, 2, 9, 30])))
    return rows


def run_packing(spark, folder, waves, breaks=(), timeout="90 seconds", forget="1 day"):
    """Waves arrive 60 seconds apart; the stream stops after each. Gives (plan, sequences)."""
    docs = {r[4]: r[5] for wave, _ in waves for r in wave if r[5]}
    tokens = spark.createDataFrame([(d, list(range(100 + d, 100 + d + n))) for d, n in docs.items()], schemas.DOC_TOKENS)
    tokens.write.parquet(f"{folder}/tokens")
    tokens = spark.read.parquet(f"{folder}/tokens")
    for wave, at in waves:
        spark.createDataFrame([(*r, None) for r in wave], SHAPE).withColumn("arrived", F.timestamp_seconds(F.lit(at))).write.mode(
            "append").parquet(f"{folder}/in")
        plan = Q.pack_stream_until(spark.readStream.schema(SHAPE).parquet(f"{folder}/in"), sequence_length=50, stride=7,
                                   timeout=timeout, forget=forget)
        start = lambda: Q.start_sequences(
            plan, tokens, folder, f"{folder}/state", sequence_length=50, stride=7, marker_id=1, bos_id=2, pad_id=3).awaitTermination()
        if at in breaks:
            real, calls = Q.append_batch, []

            def failing(rows, path, *args, **kw):
                calls.append(path)
                if path.endswith("sequences") or len(calls) > 3:
                    raise RuntimeError("broken off")
                return real(rows, path, *args, **kw)

            Q.append_batch = failing
            try:
                with pytest.raises(StreamingQueryException):
                    start()
            finally:
                Q.append_batch = real
        start()
    plan = [tuple(r) for r in Q.read_plan(spark, folder).orderBy("shard_idx", "rank", "bin", "ord").collect()]
    sequences = {(r.shard_idx, r["rank"], r.bin): r.tokens for r in Q.read_sequences(spark, folder).collect()}
    assert len(sequences) == Q.read_sequences(spark, folder).count()
    return plan, sequences


END = ([(-1, -1, -1, 0, -1, 0)], 10**6)


@pytest.mark.parametrize("breaks", [(), (120,)])
def test_packing_with_an_end(spark, tmp_path, breaks):
    rows = deal(3)
    plan, sequences = run_packing(spark, str(tmp_path), [(rows[:50], 60), (rows[50:90], 120), (rows[90:], 180), END], breaks)
    want, rests = {}, {}
    for shard in (0, 1):
        for rank in (0, 1):
            mine = [(r[4], r[5]) for r in rows if r[1:3] == (shard, rank) and r[5]]
            packed = plain.pack(mine, 50)
            want |= {(shard, rank, i): b for i, b in enumerate(packed)}
            rests[shard, rank] = mine[sum(map(len, packed)):]
    got, left = {}, {}
    for _, shard, rank, bin_, _, doc, length, _, closed in plan:
        (got.setdefault((shard, rank, bin_), []) if closed else left.setdefault((shard, rank), [])).append((doc, length))
    assert got == want and left == {k: v for k, v in rests.items() if v}
    build = lambda b: plain.build([list(range(100 + d, 100 + d + n)) for d, n in b], 50, 7, 1, 2, 3)
    assert sequences == {k: build(b) for k, b in want.items()}
    report = {(r.shard_idx, r["rank"]): (r.documents_open, r.tokens_open) for r in Q.open_rests(Q.read_plan(spark, str(tmp_path))).collect()}
    assert report == {k: (len(v), sum(n for _, n in v)) for k, v in rests.items()}


def test_rests_come_out_in_time(spark, tmp_path):
    """A group that goes quiet gives its rest out; a later document starts its next sequence, and a forgotten group starts anew."""
    key = (0, 0, 0)
    waves = [([(*key, 0, 1, 30)], 60), ([(0, 1, 0, 0, 2, 30)], 200), ([(*key, 1, 3, 30)], 260), ([(0, 1, 0, 1, 4, 1)], 400),
             ([(0, 1, 0, 2, 5, 1)], 2000), ([(*key, 2, 6, 50)], 2060), END]
    plan, sequences = run_packing(spark, str(tmp_path), waves, timeout="60 seconds", forget="1000 seconds")
    mine = [(bin_, doc, closed) for _, shard, _, bin_, _, doc, _, _, closed in plan if shard == 0]
    assert sorted(mine) == [(0, 1, False), (0, 6, True), (1, 3, False)] and set(sequences) == {(0, 0, 0)}


class _Kept:
    """One state variable of one group, kept in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None

    def getValueState(self, name, schema):
        return self

    def getListState(self, name, schema):
        return _Kept()

    def registerTimer(self, at):
        self.timer = at

    def deleteTimer(self, at):
        assert at == self.timer


def test_groups_are_packed_row_by_row():
    """A group's rows go in and out as rows: frames of a few rows cost more than packing them."""
    rng = random.Random(8)
    docs = [(d, rng.choice([0, 1, 2, 9, 30, None])) for d in range(200)]
    state, processor, got = _Kept(), Q.OpenSequences(50, 7, 1_000, 10_000), []
    processor.init(state)
    for begin in range(0, 200, 40):
        rows = [Row(turn=d, doc_id=d, len=n, arrived_ms=begin + 5) for d, n in docs[begin:begin + 40]]
        rng.shuffle(rows)
        got += processor.handleInputRows((0, 3, 1), iter(rows), None)
        assert state.timer == begin + 1_005
    want = plain.pack([(d, n or 0) for d, n in docs], 50)
    assert [(r.epoch, r.shard_idx, r["rank"], r.bin, r.ord, r.doc_id, r.len, r.closed) for r in got] == [
        (0, 3, 1, b, i, d, n, True) for b, packed in enumerate(want) for i, (d, n) in enumerate(packed)]
    for r in got:
        assert r.seq_start == sum(n + 2 + (n - 1) // 7 for _, n in want[r.bin][:r.ord])


# --- raw shards ---

def shard_rows(spark, shards=6, per=5):
    data = [(s, d, [s * 1000 + d * 10 + t for t in range(d % 4 + 1)]) for s in range(shards) for d in range(per)]
    return data, spark.createDataFrame(data, "shard_idx bigint, doc_ix bigint, tokens array<int>").repartition(3)


def collected(df):
    return sorted((r.shard_idx, r.doc_ix, r.tokens) for r in df.collect())


class Counting:
    """A file system that notes what is opened and read."""

    def __init__(self, store):
        self.store, self.opened, self.bytes = store, [], 0

    def __getattr__(self, name):
        return getattr(self.store, name)

    def open_input_file(self, path):
        self.opened.append(os.path.basename(path))
        outer, file = self, self.store.open_input_file(path)

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                file.close()

            def read_at(self, size, at):
                outer.bytes += size
                return file.read_at(size, at)

        return File()


def test_choices_open_few_files(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "raw")
    data, rows = shard_rows(spark)
    raw_shards.write_raw_shards(rows, path, {})
    read = lambda **kw: raw_shards.read_raw_shards(spark, path, **kw)
    picked = read(shards=(1, 4, 5), documents=(2, 4))
    want = [(s, d, t) for s, d, t in data if s in (1, 4, 5) and d in (2, 3)]
    assert collected(picked) == want and collected(picked.where("doc_ix = 3")) == [r for r in want if r[1] == 3]
    assert collected(read(shards=[77])) == [] and collected(read(documents=(9, 4))) == [] and collected(read(shards=[])) == []
    assert collected(read(documents=(4, 99))) == [r for r in data if r[1] == 4]
    # two scans of one table with different filters
    everything = read()
    assert everything.alias("a").join(everything.where("shard_idx = 1").alias("b"), "doc_ix").count() == len(data)
    # what one reader opens and reads
    counting = Counting(raw_shards.open_store(path)[0])
    monkeypatch.setattr(raw_shards, "open_store", lambda p: (counting, p))
    reader = raw_shards.RawShardReader(path, 4, frozenset((1, 4, 5)), range(2, 4))
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["shard_idx"], r["doc_ix"], r["tokens"]) for r in got] == want
    assert sorted(counting.opened) == [f"shard_{s:05d}.bin" for s in (1, 4, 5)] and counting.bytes == 3 * 7 * 4


def test_large_shards_are_sliced(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "raw")
    data, rows = shard_rows(spark, shards=2, per=400)
    raw_shards.write_raw_shards(rows, path, {})
    monkeypatch.setattr(raw_shards, "LEAST_BYTES", 64)
    monkeypatch.setattr(raw_shards, "TOKENS_PER_BATCH", 16)
    reader = raw_shards.RawShardReader(path, 8)
    parts = reader.partitions()
    assert len(parts) >= 8
    batches = [b for p in parts for b in reader.read(p)]
    assert max(len(b.column("tokens").flatten()) for b in batches) <= 16 + 4
    assert [(r["shard_idx"], r["doc_ix"], r["tokens"]) for b in batches for r in b.to_pylist()] == data


def test_stream_of_shards(spark, tmp_path):
    path, out = str(tmp_path / "raw"), str(tmp_path / "out")
    data, rows = shard_rows(spark)
    seen = []
    for numbers in ((0, 1), (2, 4, 5), (3,), ()):
        if numbers:
            raw_shards.write_raw_shards(rows.where(F.col("shard_idx").isin(list(numbers))), path, {})
        q = J.start_table(raw_shards.stream_raw_shards(spark, path), f"{out}/t", f"{out}/s")
        q.awaitTermination()
        seen.append({r.shard_idx for r in spark.read.parquet(f"{out}/t").collect()})
    # shard 4 waits for shard 3
    assert seen == [{0, 1}, {0, 1, 2}, set(range(6)), set(range(6))]
    assert collected(spark.read.parquet(f"{out}/t")) == data


def test_failing_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "raw")
    data, rows = shard_rows(spark)
    bad = rows.unionByName(spark.createDataFrame([(5, 99, [-1])], rows.schema))
    with pytest.raises(Exception, match="does not fit 32 bits"):
        raw_shards.write_raw_shards(bad, path, {})
    assert not os.path.exists(path) or os.listdir(path) == []
    raw_shards.write_raw_shards(rows, path, {"a": "b"})
    with pytest.raises(Exception, match="are there already"):
        raw_shards.write_raw_shards(rows.where("shard_idx = 2"), path, {})
    assert collected(raw_shards.read_raw_shards(spark, path)) == data
    assert all(n.startswith("shard_") for n in os.listdir(path))
    # rows of one shard from two tasks, or out of order
    spark.dataSource.register(raw_shards.RawShardSource)
    spread = spark.createDataFrame([(0, d, [1]) for d in range(8)], rows.schema).repartition(4)
    with pytest.raises(Exception, match="from several tasks|in order"):
        spread.write.format("raw_shards").mode("append").save(str(tmp_path / "other"))
    raw_shards.write_raw_shards(rows.where("shard_idx = 2"), path, {}, mode="overwrite")
    assert collected(raw_shards.read_raw_shards(spark, path)) == [r for r in data if r[0] == 2]
    assert sorted(os.listdir(path)) == ["shard_00002.bin", "shard_00002.idx"]


def test_paths(tmp_path):
    for path in ("/a/b", "file:/a/b", "file:///a/b"):
        store, root = raw_shards.open_store(path)
        assert store.type_name == "local" and root == "/a/b"
    assert raw_shards.shard_number("shard_00012.bin") == 12 and raw_shards.shard_number("shard_x.bin") is None
    assert raw_shards.list_shards(str(tmp_path / "none")) == {}
    np.zeros(3, dtype="<u4").tofile(tmp_path / "shard_00000.bin")
    assert raw_shards.list_shards(str(tmp_path)) == {}
    (tmp_path / "shard_00000.idx").write_text('{"documents": [{"start": 0, "end": 9}]}')
    with pytest.raises(ValueError, match="ends before"):
        list(raw_shards.read_documents(str(tmp_path), raw_shards.Slice(0, "shard_00000")))


def test_ids_of_raw_shards(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, [2**32 - 1, 0])], "shard_idx bigint, doc_ix bigint, tokens array<bigint>")
    raw_shards.write_raw_shards(df, str(tmp_path / "raw"), {})
    assert collected(raw_shards.read_raw_shards(spark, str(tmp_path / "raw"))) == [(0, 0, [2**32 - 1, 0])]
    with pytest.raises(Exception, match="token id outside"):
        S.check_ids(raw_shards.read_raw_shards(spark, str(tmp_path / "raw"))).collect()
