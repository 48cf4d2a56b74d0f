"""Pages, frequent words, mergeable sums, early caps and observed totals."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomseq import schemas
from loomseq.operators import joins, pages, scores
from loomseq.operators import sharding as S
from loomseq.operators import vocabulary as Y
from loomseq.sources.corpus import read_corpus


@pytest.mark.parametrize("page", [1, 4, 7, 10_000])
def test_pages(spark, page):
    rng = random.Random(page)
    rows, index = [], []
    for shard in range(3):
        at = 0
        for doc in range(30):
            tokens = [shard * 10_000 + at + i for i in range(rng.choice([0, 1, 2, 5, 40]))]
            rows.append((shard, at, tokens))
            index.append((shard, doc, at, at + len(tokens)))
            at += len(tokens)
    df = spark.createDataFrame(rows, "shard_idx bigint, start bigint, tokens array<int>").repartition(4)
    index = spark.createDataFrame(index, "shard_idx bigint, doc_ix bigint, start bigint, end bigint")
    table = pages.page_shards(df, page)
    for r in table.collect():
        assert r.tokens[0] == r.shard_idx * 10_000 + r.page * page and len(r.tokens) <= page
        assert r.tokens == list(range(r.tokens[0], r.tokens[0] + len(r.tokens)))
    got = {(r.shard_idx, r.doc_ix): r.tokens for r in pages.slice_pages(table, index, page).collect()}
    assert got == {(s, i % 30): t for i, (s, _, t) in enumerate(rows) if t}


def test_pages_are_joined_by_key(spark):
    """The join is an equi join on shard and page; no condition is left over."""
    index = spark.createDataFrame([(0, 0, 0, 5)], "shard_idx bigint, doc_ix bigint, start bigint, end bigint")
    table = spark.createDataFrame([(0, 0, [1] * 5)], "shard_idx bigint, page bigint, tokens array<int>")
    plan = pages.slice_pages(table, index, 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_frequent_keys_apart(spark, how):
    rng = random.Random(1)
    data = [(rng.choice(["the"] * 30 + ["of"] * 10 + [f"w{i}" for i in range(60)] + [None]), i) for i in range(3000)]
    left = spark.createDataFrame(data, "token string, i int")
    right = spark.createDataFrame([("the", 1), ("w3", 2), ("w4", 3), ("unused", 4), ("the", 5)], "token string, id int")
    if how in ("left_semi", "left_anti"):
        want = left.join(right, "token", how)
    else:
        want = left.join(right, ["token"], how)
    got = joins.join_bounded(left, right, ["token"], how, max_rows=0)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    hot = joins.frequent_values(left, "token", most=2)
    assert [r.token for r in hot.orderBy(F.desc("n")).collect()] == ["the", "of"]


def test_no_task_gets_the_frequent_word(spark):
    """Beyond the broadcast bound the shuffled side holds no hot word, and the vocabulary is not copied."""
    words = spark.range(40_000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("pos"),
        F.when(F.col("id") % 3 == 0, "the").otherwise(F.concat(F.lit("w"), F.col("id") % 5000)).alias("token"))
    vocab = spark.range(5000).select(F.concat(F.lit("w"), "id").alias("token"), F.col("id").cast("int")).unionByName(
        spark.createDataFrame([("the", 9999)], "token string, id int"))
    coded = Y.encode(words, vocab, unknown_id=-1, max_rows=0)
    assert coded.where("id IS NULL OR id < 0").count() == 0 and coded.where("id = 9999").count() == 13_334
    hot = [r.token for r in joins.frequent_values(words, "token").collect()]
    tail = words.where(~F.col("token").isin(hot)).repartition(8, "token").groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r["count"] for r in tail)
    assert "the" in hot and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_broadcast_bounds(spark):
    wide = spark.createDataFrame([("x" * 100, 1)] * 10, "a string, b int")
    assert joins.fits_broadcast(wide) and not joins.fits_broadcast(wide, max_rows=9) and not joins.fits_broadcast(wide, max_bytes=1000)
    assert joins.fits_broadcast(wide.limit(0), max_rows=0)


def test_log_sum_exp(spark):
    rng = np.random.default_rng(0)
    groups = [rng.normal(0, 3, 50), np.array([700.0, 710.0, -900.0]), np.array([-5000.0, -5001.0]), np.array([255.9, 256.1]), np.array([1e300, 1e300, -1e300]),
              np.array([-np.inf, 2.0]), np.array([-np.inf, -np.inf])]
    rows = [(g, i, float(v)) for g, values in enumerate(groups) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g int, token int, logit double").repartition(5)
    got = {r.g: r.log_norm for r in scores.log_sum_exp(df, key=["g"]).collect()}
    for g, values in enumerate(groups):
        top = values.max()
        want = top + math.log(np.exp(values - top).sum()) if top > -np.inf else -np.inf
        assert got[g] == pytest.approx(want, abs=1e-9) if np.isfinite(want) else got[g] == want
    plan = scores.log_sum_exp(df, key=["g"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Window" not in plan
    for bad in (float("nan"), None):
        with pytest.raises(Exception, match="null or NaN"):
            scores.log_sum_exp(spark.createDataFrame([(0, bad)], "g int, logit double"), key=["g"]).collect()
    assert scores.log_sum_exp(df.limit(0), key=["g"]).count() == 0


def test_logit_loss(spark):
    rows = [(p, t, float((p * 7 + t * 3) % 5), p % 4 if p else None) for p in range(9) for t in range(3)]
    df = spark.createDataFrame(rows, "pos int, token int, logit double, target int")
    want = []
    for p in range(1, 9):
        x = np.array([r[2] for r in rows if r[0] == p])
        if p % 4 < 3:
            want.append(np.log(np.exp(x).sum()) - x[p % 4])
    got = scores.logit_loss(df, key=["pos"]).first()
    assert got.positions == len(want) and got.loss == pytest.approx(np.mean(want))


@pytest.mark.parametrize("cap", [1, 7, 300, 2_000, 10**9])
def test_cap_reads_no_text_behind_it(spark, cap):
    rng = random.Random(cap)
    texts = [" ".join(["word" * rng.randint(1, 3)] * rng.choice([0, 1, 3, 50])) for _ in range(600)]
    corpus = spark.createDataFrame([(i, t if i % 50 else None, len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint")
    lengths, read = S.lengths_up_to_cap(corpus, cap)
    keep = lambda rows: sorted((r.doc_id, r.len, r.start, r.rn) for r in S.cap_tokens(S.running_lengths(rows), cap).collect())
    want = keep(S.word_lengths(corpus))
    assert keep(lengths) == want
    if cap <= 2000:
        assert read <= 1.25 * (want[-1][0] + 1) + 25
    assert lengths.select("doc_id").distinct().count() == lengths.count() == read


def test_cap_of_odd_tables(spark):
    shape = "doc_id bigint, text string, n_chars bigint"
    assert S.lengths_up_to_cap(spark.createDataFrame([], shape), 5)[0].count() == 0
    lengths, read = S.lengths_up_to_cap(spark.createDataFrame([(1, None, None), (2, "  ", 2), (3, "a b", 3)], shape), 5)
    assert sorted((r.doc_id, r.len) for r in lengths.collect()) == [(2, 0), (3, 2)] and read == 2


def test_totals_come_with_the_write(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, "d")], schemas.CORPUS)
    rows, found = S.observe_corpus(corpus)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "CollectMetrics" in plan
    rows.write.parquet(str(tmp_path / "t"))
    assert found.get == {"rows": 4, "null_text": 1, "empty_text": 1, "documents": 2, "tokens": 4}
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 4]


def test_violations(spark):
    corpus = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, None)], "doc_id bigint, text string")
    docs = spark.createDataFrame([(1, [1, 2]), (2, []), (3, [-1]), (4, [2**31]), (5, None)], "doc_id bigint, tokens array<bigint>")
    got = {r.check: r["rows"] for r in S.violations(corpus, docs).collect()}
    assert got == {"null_key": 1, "repeated_key": 2, "null_text": 1, "id_outside_range": 2, "no_tokens": 1}
    assert {r["rows"] for r in S.violations(corpus.limit(0), docs.limit(0)).collect()} == {0}


def test_split_reads_one_folder(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "test")], "doc_id bigint, text string, split string")
    df.write.partitionBy("split").parquet(str(tmp_path / "c"))
    plan = read_corpus(spark, str(tmp_path / "c"), split="train")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "(split" in plan.split("PartitionFilters")[1]
