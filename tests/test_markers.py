import pytest
from pyspark.sql import functions as F

import plain
from loomseq.functions import markers as M
from loomseq.functions import numeric as N
from loomseq.functions import words as W

C, P, B = 900, 901, 902


@pytest.fixture(scope="module")
def arrays(spark):
    rows = [(i, list(range(1, n + 1))) for i, n in enumerate([0, 1, 2, 5, 7, 8, 13, 14, 15, 21, 22, 60])]
    return spark.createDataFrame(rows, "id int, ids array<int>")


@pytest.mark.parametrize("stride", [0, -1, 1, 2, 7, 100])
def test_insert_markers(arrays, stride):
    for r in arrays.select("ids", M.insert_markers(F.col("ids"), stride, C).alias("m"),
                           M.marked_length(F.size("ids"), stride).alias("n")).collect():
        assert r.m == plain.with_markers(r.ids, stride, C)
        assert r.n == len(r.m)
        assert [t for t in r.m if t != C] == r.ids


def test_computed_ids_are_made_once(arrays):
    """Ids that an expression makes aren't made again for every chunk."""
    marked = arrays.select("ids", M.insert_markers(F.concat("ids", F.reverse("ids")), 7, C).alias("m"))
    for r in marked.collect():
        assert r.m == plain.with_markers(r.ids + r.ids[::-1], 7, C)
    assert marked._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1
    assert arrays.select(M.insert_markers(F.lit(None).cast("array<int>"), 7, C)).first()[0] is None


def test_labels_follow_tokens(spark):
    df = spark.createDataFrame([([10, 11, 12, 20, 21], [0, 0, 0, 1, 1])], "t array<int>, l array<int>")
    t, l = M.insert_markers_with_labels(F.col("t"), F.col("l"), 2, C)
    assert df.select(t.alias("t"), l.alias("l")).first() == ([10, 11, C, 12, 20, C, 21], [0, 0, 0, 0, 1, 0, 1])
    t, l = M.insert_markers_with_labels(F.col("t"), F.col("l"), 2, C, use_markers=False)
    assert df.select(t.alias("t"), l.alias("l")).first() == ([10, 11, 12, 20, 21], [0, 0, 0, 1, 1])


def test_unequal_labels_fail(spark):
    df = spark.createDataFrame([([1, 2], [0])], "t array<int>, l array<int>")
    t, l = M.insert_markers_with_labels(F.col("t"), F.col("l"), 2, C)
    with pytest.raises(Exception, match="a label is needed"):
        df.select(t, l).collect()


def test_since_and_append(spark):
    df = spark.createDataFrame([(0, [1, 2, C, 3]), (1, [1, 2]), (2, [1, C]), (3, [])], "id int, ids array<int>")
    got = df.select("id", M.tokens_since_last_marker(F.col("ids"), C).alias("s"),
                    M.maybe_append_marker(F.col("ids"), C, 2).alias("a")).orderBy("id").collect()
    assert [r.s for r in got] == [1, 2, 0, 0]
    assert [r.a for r in got] == [[1, 2, C, 3], [1, 2, C], [1, C], []]


def test_wrap_and_prompt(spark):
    df = spark.createDataFrame([([1, 2, 3], [4])], "p array<int>, c array<int>")
    assert df.select(M.wrap_document(F.col("p"), 2, C, B, P)).first()[0] == [B, 1, 2, C, 3, P]
    t, l = M.prompt_sequence(F.col("p"), F.col("c"), stride=2, marker_id=C, bos_id=B)
    assert df.select(t.alias("t"), l.alias("l")).first() == ([B, 1, C, 2, 3, C, 4], [0, 0, 0, 0, 0, 0, 1])


def test_numbers(spark):
    df = spark.createDataFrame([(v,) for v in (-129, -128, -7, 0, 1, 127, 128, 300)], "v bigint")
    for r in df.select("v", N.floor_multiple(F.col("v"), 128).alias("f"), N.ceil_div(F.col("v"), 128).alias("c"),
                       N.round_up(F.col("v"), 128).alias("r"), N.floor_multiple(F.col("v"), 1).alias("same")).collect():
        assert r.f == r.v // 128 * 128 and r.c == -(-r.v // 128) and r.r == -(-r.v // 128) * 128 and r.same == r.v


def test_seeds(spark):
    df = spark.createDataFrame([(e, p) for e in (0, 1, 5) for p in (0, 1, 77_777)], "e int, p bigint")
    for r in df.select("e", "p", N.epoch_seed(42, F.col("e")).alias("s"),
                       N.document_seed(42, F.col("e"), F.col("p")).alias("d")).collect():
        assert r.s == (42 << 32) ^ (r.e * 1315423911)
        assert r.d == (42 << 32) ^ (r.e * 1315423911) ^ (r.p * 2654435761)
    with pytest.raises(ValueError):
        N.epoch_seed(-1, F.lit(0))


def test_text(spark):
    df = spark.createDataFrame([("  a b \n",)], "t string")
    assert df.select(W.strip(F.col("t"))).first()[0] == "a b"
    assert df.select(W.title_text(F.lit("attention__scores_x"))).first()[0] == "Attention Scores X"
    assert df.select(N.shard_stem(F.lit(7))).first()[0] == "shard_00007"
    null = spark.createDataFrame([(None,), ("",), (" \n",)], "t string")
    assert [r[0] for r in null.select(W.word_hash_tokens(F.col("t"))).collect()] == [None, [], []]
