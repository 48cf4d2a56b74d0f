import hashlib
import random

import pytest
from pyspark.sql import functions as F

import plain
from loomseq.functions import words as W
from loomseq.operators import packing as P
from loomseq.plans import jobs

C, PAD, B = W.MARKER_ID, W.PAD_ID, W.BOS_ID


def small_corpus(spark, n=120, seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.choice([0, 1, 3, 10, 40, 200])))) for i in range(n)]
    rows[5] = (5, None)
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), rows


def ids(text):
    return [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 32000 for w in (text or "").split()]


def expected(rows, s):
    docs = {k: ids(t) for k, t in rows if t is not None}
    index = plain.cut([(k, len(docs[k])) for k in sorted(docs)], s.tokens_per_shard)
    shards = {}
    for key, shard, ix, *_ in index:
        shards.setdefault(shard, []).append((ix, key))
    md5 = lambda seed, item: hashlib.md5(f"{seed}:{item}".encode()).hexdigest()
    out = {}
    for epoch in range(s.epochs):
        seed = (s.base_seed << 32) ^ (epoch * 1315423911)
        count = [0] * s.world_size
        for place, shard in enumerate(sorted(shards, key=lambda x: md5(seed, x))):
            own = seed ^ (place * 2654435761)
            order = sorted(shards[shard], key=lambda d: (md5(own, d[0]), d[0]))
            for rank in range(s.world_size):
                mine = [(k, len(docs[k])) for i, (_, k) in enumerate(order) if i % s.world_size == rank]
                for bin_ in plain.pack(mine, s.sequence_length):
                    out[epoch, rank, count[rank]] = plain.build(
                        [docs[k] for k, _ in bin_], s.sequence_length, s.stride, C, B, PAD)
                    count[rank] += 1
    return out


@pytest.mark.parametrize("settings", [
    jobs.SequenceSettings(tokens_per_shard=700, sequence_length=64, stride=7, world_size=2, epochs=2, base_seed=42),
    jobs.SequenceSettings(tokens_per_shard=10**6, sequence_length=50, stride=0, world_size=3, epochs=1, base_seed=0),
    jobs.SequenceSettings(tokens_per_shard=60, sequence_length=300, stride=2, world_size=1, epochs=1, base_seed=1),
    jobs.SequenceSettings(tokens_per_shard=300, sequence_length=20, stride=1, world_size=5, epochs=3, base_seed=9),
])
def test_sequences_equal_the_loop(spark, settings):
    corpus, rows = small_corpus(spark)
    index = jobs.index_corpus(corpus, settings)
    bins = P.number_sequences(jobs.plan_bins(index, settings))
    from loomseq.operators import sharding as S

    got = {(r.epoch, r["rank"], r.seq_ix): r.tokens
           for r in jobs.sequences(bins, S.tokenize(corpus), settings).collect()}
    assert got == expected(rows, settings)
    assert all(len(t) == settings.sequence_length for t in got.values())


def test_batches_of_any_size_give_the_same_bins(spark):
    settings = jobs.SequenceSettings(tokens_per_shard=5_000, sequence_length=40, stride=3, world_size=2, epochs=2)
    corpus, _ = small_corpus(spark, 150)
    index = jobs.index_corpus(corpus, settings)
    plan = lambda: sorted(tuple(r) for r in jobs.plan_bins(index, settings).collect())
    want = plan()
    try:
        for size in (1, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert plan() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # no document is on two ranks in one epoch
    seen = {}
    for epoch, _, _, rank, *_ , doc, _, _, _ in want:
        assert seen.setdefault((epoch, doc), rank) == rank


def test_empty_documents_take_their_turn(spark):
    lens = [3, 0, 4, 1, 2]
    df = spark.createDataFrame([(i, 0, i, 0, n) for i, n in enumerate(lens)],
                               "doc_id bigint, shard_idx bigint, doc_ix bigint, start bigint, end bigint")
    dealt = P.deal_documents(df, epochs=1, world_size=2, base_seed=0)
    turns = {r.doc_id: (r.turn, r["rank"]) for r in dealt.collect()}
    assert sorted(t for t, _ in turns.values()) == [0, 1, 2, 3, 4]
    assert all(rank == turn % 2 for turn, rank in turns.values())
    packed = {r.doc_id for r in P.pack_bins(dealt, sequence_length=1, stride=7).collect()}
    assert packed == {0, 2, 3, 4}
    assert {r.doc_id for r in P.pick_rank(dealt, 1).collect()} == {k for k, (_, r) in turns.items() if r == 1}


def test_packing_loss_adds_up(spark):
    settings = jobs.SequenceSettings(tokens_per_shard=700, sequence_length=64, stride=7, world_size=2, epochs=1)
    corpus, _ = small_corpus(spark)
    bins = jobs.plan_bins(jobs.index_corpus(corpus, settings), settings)
    from loomseq.operators import sharding as S

    packed = jobs.sequences(bins, S.tokenize(corpus), settings)
    ordinary = packed.select(
        "epoch", "shard_idx", "rank", "bin",
        F.size(F.filter("tokens", lambda t: ~t.isin(C, PAD, B))).alias("kept"))
    loss = P.packing_loss(bins, sequence_length=64, stride=7).join(ordinary, ["epoch", "shard_idx", "rank", "bin"])
    rows = loss.collect()
    assert rows and all(r.raw_kept == r.kept and r.raw_kept + r.raw_cut == r.raw_taken for r in rows)


def test_parameters():
    for kw in ({"sequence_length": 0}, {"world_size": 0}):
        with pytest.raises(ValueError):
            jobs.SequenceSettings(**kw)
    with pytest.raises(ValueError):
        P.check_parameters(1, 2, rank=2)
