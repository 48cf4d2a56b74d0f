import random

import pytest
from pyspark.sql import functions as F

import plain
from loomseq import schemas
from loomseq.operators import packing as P
from loomseq.operators import sharding as S
from loomseq.sources import corpus as R
from loomseq.sources.metric_sink import read_logged
from loomseq.streaming import jobs as J


@pytest.fixture()
def arriving(spark, tmp_path):
    """Documents in nine files that arrive in key order, one per micro-batch."""
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 2, 9, 30]))) for i in range(200)]
    folder = tmp_path / "in"
    for b in range(9):
        part = spark.createDataFrame(rows[b * 23:(b + 1) * 23], schemas.CORPUS)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return R.stream_corpus(spark, str(folder), max_files=1), rows


def run(spark, stream, tmp_path, name):
    q = J.start_table(stream, str(tmp_path / name), str(tmp_path / f"{name}-state"))
    q.awaitTermination()
    assert len({p["batchId"] for p in q.recentProgress}) > 3
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name))


def test_tokenize(spark, arriving, tmp_path):
    stream, rows = arriving
    got = run(spark, J.tokenize_stream(stream), tmp_path, "tokens")
    assert {r.doc_id: len(r.tokens) for r in got.collect()} == {k: len(t.split()) for k, t in rows}


@pytest.mark.parametrize("target", [5, 37, 400, 10**6])
def test_cut_equals_batch(spark, arriving, tmp_path, target):
    stream, rows = arriving
    lengths = S.word_lengths(stream).withColumn("lane", F.lit(0))
    got = run(spark, J.cut_stream(lengths, target), tmp_path, "cut")
    want = plain.cut([(k, len(t.split())) for k, t in rows], target)
    assert sorted((r.doc_id, r.shard_idx, r.doc_ix, r.start, r.end) for r in got.collect()) == want


@pytest.mark.parametrize("stride", [0, 7])
def test_pack_equals_loop(spark, arriving, tmp_path, stride):
    stream, rows = arriving
    dealt = S.word_lengths(stream).withColumn("rank", F.pmod("doc_id", F.lit(2)).cast("int"))
    plan = run(spark, J.pack_stream(dealt, 50, stride), tmp_path, "pack")
    got = {}
    for r in plan.orderBy("rank", "bin", "ord").collect():
        got.setdefault((r["rank"], r.bin), []).append((r.doc_id, r.len))
    want = {}
    for rank in (0, 1):
        mine = [(k, len(t.split())) for k, t in rows if k % 2 == rank]
        for i, b in enumerate(plain.pack(mine, 50)):
            want[rank, i] = b
    assert got == want
    # the plan feeds the batch builder
    docs = S.tokenize(spark.createDataFrame(rows, schemas.CORPUS))
    built = P.build_sequences(plan.withColumn("epoch", F.lit(0)).withColumn("shard_idx", F.lit(0)), docs,
                              sequence_length=50, stride=stride, marker_id=1, bos_id=2, pad_id=3).collect()
    assert len(built) == len(want) and {len(r.tokens) for r in built} == {50}


def test_metric_log(spark, tmp_path):
    rows = [("r", s, "loss", float(s)) for s in range(30)]
    spark.createDataFrame(rows, schemas.METRICS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schemas.METRICS).parquet(str(tmp_path / "in"))
    J.start_metric_log(stream, str(tmp_path / "out"), str(tmp_path / "state"), every=10).awaitTermination()
    assert sorted(r.step for r in read_logged(spark, str(tmp_path / "out")).collect()) == [0, 1, 10, 20]
