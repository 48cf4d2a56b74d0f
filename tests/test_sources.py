import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomseq.functions import vectors as V
from loomseq.operators import scores as K
from loomseq.operators import sharding as S
from loomseq.sources import corpus as R
from loomseq.sources import metric_sink, raw_shards, shard_table


def shard_data():
    return [(s, d, [s * 1000 + d * 10 + t for t in range(n)]) for s in (0, 1, 12) for d, n in enumerate((3, 1, 5))]


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(shard_data() + [(1, 3, [])], "shard_idx bigint, doc_ix bigint, tokens array<int>").repartition(3)


def test_raw_round_trip(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "raw")
    manifest = raw_shards.export_raw_shards(rows, path, {"dataset": "x"})
    assert sorted(os.listdir(path)) == [f"shard_{s:05d}.{k}" for s in (0, 1, 12) for k in ("bin", "idx")]
    assert {r.shard_idx: (r.documents, r.num_tokens) for r in manifest.collect()} == {s: (3, 9) for s in (0, 1, 12)}
    flat = np.fromfile(f"{path}/shard_00001.bin", dtype="<u4").tolist()
    assert flat == [t for s, _, ts in shard_data() if s == 1 for t in ts]
    index = json.load(open(f"{path}/shard_00001.idx"))
    assert index == {"documents": [{"start": 0, "end": 3}, {"start": 3, "end": 4}, {"start": 4, "end": 9}],
                     "num_tokens": 9, "metadata": {"dataset": "x"}}
    back = raw_shards.read_raw_shards(spark, path)
    assert sorted((r.shard_idx, r.doc_ix, r.tokens) for r in back.collect()) == shard_data()
    read = raw_shards.read_index(spark, path).orderBy("shard_idx").collect()
    assert [(r.shard_idx, r.num_tokens, r.metadata) for r in read] == [(s, 9, {"dataset": "x"}) for s in (0, 1, 12)]
    found = raw_shards.discover_shards(spark, path).collect()
    assert [r.shard_idx for r in found] == [0, 1, 12]


def test_raw_read_in_small_pieces(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "raw")
    raw_shards.export_raw_shards(rows, path, {})
    monkeypatch.setattr(raw_shards, "LEAST_BYTES", 36)
    monkeypatch.setattr(raw_shards, "TOKENS_PER_BATCH", 2)
    reader = raw_shards.RawShardReader(path, 3)
    parts = reader.partitions()
    assert len(parts) == 3
    batches = [b for p in parts for b in reader.read(p)]
    assert len(batches) > 3
    got = [(r["shard_idx"], r["doc_ix"], r["tokens"]) for b in batches for r in b.to_pylist()]
    assert got == shard_data()


def test_orphans(spark, rows, tmp_path):
    path = str(tmp_path / "raw")
    raw_shards.export_raw_shards(rows, path, {})
    np.zeros(1, dtype="<u4").tofile(f"{path}/shard_00077.bin")
    report = {r.shard_idx: r.idx_path for r in raw_shards.discover_shards(spark, path, strict=False).collect()}
    assert report[77] is None and report[0] is not None
    with pytest.raises(Exception, match="without its partner"):
        raw_shards.discover_shards(spark, path).collect()
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        raw_shards.discover_shards(spark, str(empty))


def test_shard_table(spark, rows, tmp_path):
    path = str(tmp_path / "shards")
    shard_table.write_shards(rows.where(F.size("tokens") > 0), path, per_folder=10, per_file=2)
    got = shard_table.read_shards(spark, path).collect()
    assert sorted((r.shard_idx, r.doc_ix, r.tokens) for r in got) == shard_data()
    some = shard_table.read_shards(spark, path, [12], per_folder=10)
    assert {r.shard_idx for r in some.collect()} == {12}
    assert len(some.inputFiles()) <= 2  # one folder


def test_metadata(spark):
    index = spark.createDataFrame(
        [(1, 0, 0, 0, 3), (2, 0, 1, 3, 5), (3, 1, 0, 0, 4)],
        "doc_id bigint, shard_idx bigint, doc_ix bigint, start bigint, end bigint")
    table = S.shard_index(index, {"dataset": "d", "max_tokens": str(None)})
    first = table.orderBy("shard_idx").first()
    assert json.loads(first.index_json)["documents"] == [{"start": 0, "end": 3}, {"start": 3, "end": 5}]
    assert S.dataset_metadata(table).first() == ({"dataset": "d", "max_tokens": "None"}, True)
    assert S.dataset_metadata(S.shard_index(index, {}).where("false")).first()[0] == {}
    parsed = shard_table.parse_index_json(table.select("shard_idx", "index_json")).orderBy("shard_idx").first()
    assert parsed.num_tokens == 5 and parsed.metadata["dataset"] == "d"


def test_corpus_split_and_subjects(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "test")], "doc_id bigint, text string, split string")
    df.write.partitionBy("split").parquet(str(tmp_path / "c"))
    assert [r.doc_id for r in R.read_corpus(spark, str(tmp_path / "c"), split="train").collect()] == [1]
    df.write.json(str(tmp_path / "j"))
    assert R.read_corpus(spark, str(tmp_path / "j"), fmt="json").count() == 2
    items = spark.createDataFrame([("x", 1), ("y", 2)], "subject string, item_id bigint")
    items.write.partitionBy("subject").parquet(str(tmp_path / "m"))
    assert [r.item_id for r in R.read_subjects(spark, str(tmp_path / "m"), ["y", "gone"]).collect()] == [2]


def test_metric_table(spark, tmp_path):
    rows = spark.createDataFrame([("r", 1, "loss", 2.0), ("q", 1, "loss", 3.0)], "run_id string, step bigint, metric string, value double")
    for _ in range(2):
        metric_sink.write_metrics(rows, str(tmp_path / "m"))
    assert metric_sink.read_metrics(spark, str(tmp_path / "m")).count() == 4
    assert metric_sink.read_metrics(spark, str(tmp_path / "m"), "r").count() == 2


def test_repeated_pair(spark):
    df = spark.createDataFrame([(1, [5, 6])], "doc_id bigint, tokens array<int>")
    got = R.repeated_pair(df, pad_id=9, times=3).collect()
    assert [r.tokens for r in got] == [[5, 6, 9, 5, 6, 9]] * 3
    assert R.repeated_pair(df, pad_id=9, times=0).count() == 0


def test_check_ids(spark):
    df = spark.createDataFrame([([1, 2],)], "tokens array<bigint>")
    assert S.check_ids(df).first()[0] == [1, 2]
    for bad in (-1, 2**31):
        with pytest.raises(Exception, match="token id outside"):
            S.check_ids(spark.createDataFrame([([bad],)], "tokens array<bigint>")).collect()


def test_slice_documents(spark):
    shards = spark.createDataFrame([(0, [1, 2, 3, 4])], "shard_idx bigint, tokens array<int>")
    index = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 1, 4)], "shard_idx bigint, doc_ix bigint, start bigint, end bigint")
    assert sorted((r.doc_ix, r.tokens) for r in S.slice_documents(shards, index).collect()) == [(0, [1]), (1, [2, 3, 4])]


def test_vectors(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, [3.0, -1.0]), (1, 0, [1.0, 1.0])], "seq int, pos int, vec array<float>")
    rows = {(r.seq, r.q_pos): r.scores for r in K.score_rows(df, key=["seq"], mask=lambda q, k: q["pos"] >= k["pos"]).collect()}
    assert rows[0, 0] == [pytest.approx(5 / 2**0.5), float("-inf")]
    assert rows[0, 1] == [pytest.approx(1 / 2**0.5), pytest.approx(10 / 2**0.5)]
    plus = {(r.seq, r.q_pos): r.scores for r in K.score_rows(
        df, key=["seq"], scale=1.0, score_mod=lambda s, q, k: s + k["pos"]).collect()}
    assert plus[0, 0] == [5.0, 2.0]
    lp = V.with_log_softmax(df, "vec", "lp").select("vec", "lp", V.argmax(F.col("vec")).alias("a")).collect()
    for r in lp:
        x = np.array(r.vec)
        assert np.allclose(r.lp, x - np.log(np.exp(x).sum())) and r.a == int(np.argmax(x))
    long = df.select("seq", "pos", F.posexplode("vec").alias("token", "logit"))
    key = ["seq", "pos"]
    soft = K.log_softmax_long(long, key=key)
    flat = {(r.seq, r.pos, r.token): r.logp for r in soft.collect()}
    assert flat[0, 0, 0] == pytest.approx(-np.log1p(np.e))
    assert {(r.seq, r.pos): r.pred for r in K.argmax_long(long, key=key).collect()} == {(0, 0): 1, (0, 1): 0, (1, 0): 0}
    targets = spark.createDataFrame([(0, 1, 1)], "seq int, pos int, token int")
    assert K.gather_long(soft, targets, key).first().logp == pytest.approx(flat[0, 1, 1])
