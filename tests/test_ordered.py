import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from loomseq.operators import ordered as O
from loomseq.operators import sharding as S


def lengths_table(spark, lengths, parts=3):
    rows = [(k * 3, n) for k, n in enumerate(lengths)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id bigint, len bigint").repartition(parts), sorted(rows)


def shapes():
    rng = random.Random(7)
    yield "random", [rng.randint(0, 30) for _ in range(400)]
    yield "uniform", [5] * 300
    yield "ones", [1] * 300
    yield "giants", [rng.choice([1, 2, 500, 3, 2_000]) for _ in range(150)]
    yield "one giant", [100_000]
    yield "giant in front", [9_999] + [1] * 200
    yield "all empty", [0, 0, 0]
    yield "long tail", [50] * 5 + [1] * 20


@pytest.mark.parametrize("name,lengths", list(shapes()), ids=[n for n, _ in shapes()])
def test_cut_equals_running_sum(spark, name, lengths):
    df, rows = lengths_table(spark, lengths)
    for target, size, fan, width in [(17, 5, 2, 16), (100, 65_536, 8, 65_536), (10, 40, 3, 100), (300, 1, 2, 100)]:
        got = S.assign_shards(df, target, block_rows=size, fan_in=fan, width=width)
        assert sorted(tuple(r) for r in got.collect()) == plain.cut(rows, target), (name, target, size)


def test_block_summary_is_small_when_lengths_vary():
    rng = np.random.default_rng(3)
    ends = np.cumsum(rng.integers(1, 900, 80_000))
    target, start = 16_384, 0
    one = np.ones(len(ends), dtype=np.int64)
    hi, *_ = O._summarise(ends, ends, np.arange(len(ends)), one, start, target)
    assert len(hi) <= 3  # chains from all entries have met


def test_worked_cut(spark):
    df, _ = lengths_table(spark, [5, 5, 5, 9, 1, 20, 3])
    got = S.assign_shards(df, 10).orderBy("doc_id").collect()
    assert [r.shard_idx for r in got] == [0, 0, 1, 1, 2, 2, 3]


def test_token_cap_keeps_the_crossing_document(spark):
    df, _ = lengths_table(spark, [5, 5, 5, 9, 1, 20, 3])
    running = S.running_lengths(df, width=4)
    assert [r.start for r in S.cap_tokens(running, 12).orderBy("doc_id").collect()] == [0, 5, 10]
    assert S.cap_tokens(running, 0).count() == S.cap_tokens(running, None).count() == 7


@pytest.mark.parametrize("n", [0, -1, 1, 5, 100])
def test_sample_cap(spark, n):
    df = spark.createDataFrame([(i * 10, "" if i % 3 else "x") for i in range(30)], "doc_id bigint, text string")
    got = sorted(r.doc_id for r in S.cap_samples(df.repartition(5), n, width=50).collect())
    assert got == [i * 10 for i in range(30)][:max(n, 0)]
    assert S.cap_samples(df, None) is df


def test_prefix_sums_by_group(spark):
    rng = random.Random(2)
    rows = [(g, k, rng.randint(0, 9)) for g in "ab" for k in rng.sample(range(-100, 100), 60)]
    df = spark.createDataFrame(rows, "g string, k bigint, v bigint")
    want = {(g, k): (sum(v for h, j, v in rows if h == g and j < k), sum(1 for h, j, _ in rows if h == g and j < k))
            for g, k, _ in rows}
    for parts in (1, 4, 64):
        got = O.prefix_sums(df.repartition(parts), "k", {"s": "v", "n": "*"}, by=["g"], width=13).collect()
        assert {(r.g, r.k): (r.s, r.n) for r in got} == want


def test_ordered_rank(spark):
    df = spark.range(500).select("id", F.md5(F.col("id").cast("string")).alias("k"))
    want = {r.id: i for i, r in enumerate(sorted(df.collect(), key=lambda r: r.k))}
    assert {r.id: r.n for r in O.ordered_rank(df, "k", "n", digits=2).collect()} == want


@pytest.mark.parametrize("kind", ["sparse", "clustered", "text"])
def test_prefix_sums_over_awkward_keys(spark, kind):
    rng = random.Random(6)
    if kind == "sparse":
        keys = [rng.randint(-2**62, 2**62) for _ in range(300)]
    elif kind == "clustered":
        keys = list(range(200)) + [rng.randint(2**40, 2**62) for _ in range(100)]
    else:
        keys = [f"k{v:09d}" for v in rng.sample(range(10**8), 300)]
    rows = [(k, rng.randint(0, 9)) for k in keys]
    df = spark.createDataFrame(rows, ["k", "v"]).repartition(5)
    got = {r.k: (r.s, r.n) for r in O.prefix_sums(df, "k", {"s": "v", "n": "*"}, width=8).collect()}
    total, want = 0, {}
    for n, (k, v) in enumerate(sorted(rows)):
        want[k] = (total, n)
        total += v
    assert got == want
    # a table this small would be coalesced into one range
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = O.key_ranges(df, "k", 8).groupBy("__range").count().collect()
        assert {r.k: (r.s, r.n) for r in O.prefix_sums(df, "k", {"s": "v", "n": "*"}, width=8).collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 200


@pytest.mark.parametrize("kind", ["mixed", "equal"])
def test_folds_stay_small_at_large_targets(kind):
    """At a target of 100 million tokens no fold takes more than two million rows."""
    rng = np.random.default_rng(1)
    target, blocks, rows, fan = (100_000_000, 64, O.BLOCK_ROWS, O.FAN_IN)
    size = {"mixed": lambda: rng.integers(1, 800, rows), "equal": lambda: np.full(rows, 400)}[kind]
    at, number, level, lengths = 0, 0, [], []
    for _ in range(blocks):
        length = size()
        hi = at + np.cumsum(length)
        level.append((at, O._summarise(hi, hi, number + np.arange(rows), np.ones(rows, dtype=np.int64), at, target)))
        at, number = int(hi[-1]), number + rows
        lengths.append(length)
    largest = 0
    while len(level) > fan:
        folded = []
        for k in range(0, len(level), fan):
            nodes = [np.concatenate(c) for c in zip(*(n for _, n in level[k : k + fan]))]
            largest = max(largest, len(nodes[0]))
            folded.append((level[k][0], O._summarise(*nodes, level[k][0], target)))
        level = folded
    nodes = [np.concatenate(c) for c in zip(*(n for _, n in level))]
    assert max(largest, len(nodes[0])) <= 2_100_000
    _, states = O._walk(*nodes, 0, -1, 0, target)
    assert states[-1][2] == len(O.cut_positions(np.concatenate(lengths), target))
