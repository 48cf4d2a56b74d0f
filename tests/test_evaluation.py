import math
import random

import pytest
from pyspark.sql import functions as F

from loomseq import schemas
from loomseq.operators import evaluation as E
from loomseq.operators import joins as J
from loomseq.operators import metrics as X
from loomseq.operators import vocabulary as Y
from loomseq.plans import jobs, queries


def test_answers(spark):
    rows = [("B", True), (" c) because", True), ("", True), ("2", True), ("1", False), (None, True), ("99", False),
            ("3.7", False), ("x", False), (" d", True)]
    df = spark.createDataFrame(rows, "a string, t boolean")
    got = [r[0] for r in df.select(E.answer_index(F.col("a"), F.col("t"))).collect()]
    assert got == [1, 2, None, None, 1, None, 99, 3, None, 3]


def test_prompt_and_many_choices(spark):
    df = spark.createDataFrame([(" Q? ", [" x ", "y"]), ("R", [str(i) for i in range(27)])], "q string, ch array<string>")
    got = [r[0] for r in df.select(E.format_prompt(F.col("q"), F.col("ch"))).collect()]
    assert got[0] == "Q?\nA. x\nB. y\nAnswer:"
    assert got[1].split("\n")[-2] == "Z. 25"
    rows = E.expand_choices(df.where("q = 'R'")).orderBy("choice_idx").collect()
    assert [r.completion for r in rows] == [f" {chr(65 + i)}" for i in range(26)]


def test_scores_and_ties(spark):
    rows = [(1, 0, 0, 1, -1.0), (1, 1, 0, 1, 3.0), (1, 2, 0, 1, 3.0), (2, 0, 0, 0, -5.0), (2, 1, 0, 1, -9.0)]
    scores = E.choice_scores(spark.createDataFrame(rows, schemas.CHOICE_LOGP))
    assert {(r.item_id, r.choice_idx): r.score for r in scores.collect()}[2, 0] == -math.inf
    assert {r.item_id: r.pred_idx for r in E.best_choice(scores).collect()} == {1: 1, 2: 1}
    with pytest.raises(Exception, match="NaN"):
        E.best_choice(spark.createDataFrame([(1, 0, math.nan)], "item_id bigint, choice_idx bigint, score double")).collect()


def test_report(spark):
    item = lambda s, i, q, ch, a, t=True: (s, i, q, ch, None, a, t)
    items = spark.createDataFrame([
        item("math", 1, "q", ["a", "b"], "B"), item("math", 2, "", ["a"], "A"), item("math", 3, "q", ["a", "b"], "7"),
        item("math", 4, "q", ["a", "b"], "0", False), item("law", 5, "q", ["a", "b"], "9", False),
        item("other", 6, "q", ["a", "b"], "A")], schemas.MULTIPLE_CHOICE)
    logp = spark.createDataFrame(
        [(i, c, 0, 1, float(c)) for i in range(1, 7) for c in range(4)], schemas.CHOICE_LOGP)
    got = {(r.subject, r.level): (r.correct, r.total, r.accuracy)
           for r in jobs.multiple_choice_report(items, logp, ["math", "law", "gone"]).collect()}
    assert got == {("math", 0): (1, 2, 0.5), ("law", 0): (0, 1, 0.0), ("gone", 0): (0, 0, 0.0),
                   (None, 1): (1, 3, 1 / 3)}
    # The cap counts items before the invalid ones are dropped.
    capped = jobs.multiple_choice_report(items, logp, ["math"], max_items=2).collect()
    assert {r.subject: r.total for r in capped}["math"] == 1
    metrics = X.accuracy_metrics(jobs.multiple_choice_report(items, logp, ["math"]), "run", 500)
    assert {r.metric: r.value for r in metrics.collect()} == {"mmlu_overall": 0.5, "mmlu_math": 0.5}


def test_options_stand_in_for_choices(spark):
    rows = [("s", 1, "q", [], ["o"], "A", True), ("s", 2, "q", None, ["o"], "A", True), ("s", 3, "q", None, None, "A", True)]
    got = E.valid_items(spark.createDataFrame(rows, schemas.MULTIPLE_CHOICE)).collect()
    assert [(r.item_id, r.ch) for r in sorted(got)] == [(1, ["o"]), (2, ["o"])]


def test_first_items_limits_before_the_shuffle(spark):
    items = spark.range(1000).select(F.when(F.col("id") % 90 != 7, "hot").otherwise("cold").alias("subject"), F.col("id").alias("item_id"))
    capped = E.first_items(items.repartition(8), 25)
    hot = [i for i in range(1000) if i % 90 != 7][:25]
    assert sorted(r.item_id for r in capped.where("subject = 'hot'").collect()) == hot
    assert "WindowGroupLimit" in capped._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("max_rows", [10, 1])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_bounded(spark, how, max_rows):
    left = spark.createDataFrame([(i % 4, i) for i in range(200)], "k int, v int")
    right = spark.createDataFrame([(0, "a"), (2, "b")], "k int, w string")
    want = sorted(map(str, left.join(right, "k", how).collect()))
    assert sorted(map(str, J.join_bounded(left, right, ["k"], how, max_rows=max_rows).collect())) == want


def test_vocabulary_round_trip(spark):
    corpus = spark.createDataFrame([(1, "b a  b"), (2, "c"), (3, "a zzz")], "doc_id bigint, text string")
    vocab = Y.with_specials(Y.word_vocabulary(Y.explode_words(corpus.where("doc_id < 3"))))
    rows = {r.token: (r.id, r.is_special) for r in vocab.collect()}
    assert sorted(i for i, s in rows.values() if not s) == [0, 1, 2]
    assert [rows[s] for s in Y.SPECIAL_TOKENS] == [(3, True), (4, True), (5, True)]
    assert Y.special_ids(vocab).first()[0] == [3, 4, 5]
    assert Y.with_specials(vocab.select("token", "id")).count() == 6
    for limit in (100, 1):
        ids = Y.encode(Y.explode_words(corpus), vocab, unknown_id=4, max_rows=limit).groupBy("doc_id").agg(
            F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("c")).select("doc_id", F.col("c.id").alias("tokens"))
        back = {r.doc_id: r.text for r in Y.decode(ids, vocab, max_rows=limit).collect()}
        assert back == {1: "b a b", 2: "c", 3: "a <|pad|>"}
    long = spark.createDataFrame([(0, 3), (1, 1), (2, 5)], "pos int, token int")
    assert sorted(r.token for r in Y.keep_special(long, vocab).collect()) == [3, 5]
    assert [r.token for r in Y.keep_special(long, vocab, keep=False).collect()] == [1]


def test_metrics(spark):
    C = 9
    rows = [(1, 0, 5, 5, 0, -1.0), (1, 1, C, -100, 5, -2.0), (1, 2, 6, 6, 0, -4.0), (1, 3, C, -100, 7, -8.0),
            (2, 0, 5, 5, 5, -1.0)]
    df = spark.createDataFrame(rows, schemas.PREDICTIONS)
    acc = {r.seq_id: r.marker_accuracy for r in X.marker_accuracy(df, C, by=["seq_id"]).collect()}
    assert acc[1] == 0.5 and math.isnan(acc[2])
    nxt = {r.seq_id: r.marker_accuracy for r in X.marker_accuracy(df, C, by=["seq_id"], shift=-1).collect()}
    assert nxt[1] == 0.0
    loss = {r.seq_id: r.loss for r in X.masked_loss(df, by=["seq_id"]).collect()}
    assert loss == {1: 2.0, 2: None}
    assert [r.target for r in X.next_token_targets(df).orderBy("pos").collect()] == [C, 6, C]
    labelled = spark.createDataFrame([(1, 0, 5, 0), (1, 1, 6, 1), (1, 2, 7, 1)], "seq_id int, pos int, token int, label int")
    assert sorted(r.pos for r in X.choice_targets(labelled, key=["seq_id"]).collect()) == [0, 1]
    steps = spark.range(0, 25).withColumnRenamed("id", "step")
    assert sorted(r.step for r in X.log_steps(steps, 10).collect()) == [0, 1, 10, 20]
    assert sorted(r.step for r in X.eval_steps(steps, 10).collect()) == [0, 10, 20]
    assert sorted(r.pos for r in X.marker_rows(df, C).collect()) == [1, 3]


def _corpus_of(spark, path):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["ab", "c", "def", "g"]) for _ in range(n))
    rows = [(i, words(rng.choice([0, 1, 5, 40, 200])), "src1") for i in range(40)] + [(50, None, "src1"), (None, words(9), "src2")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_choice_targets_follow_prompt_sequences(spark, tmp_path):
    sf = _corpus_of(spark, tmp_path)
    prompts = queries.prompt_sequences(spark, sf).collect()
    want = {(r.item_id, r.choice_idx, i) for r in prompts for i, label in enumerate(r.labels.split(",")[1:]) if label == "1"}
    got = queries.choice_targets(spark, sf)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50
    # rows are unfolded last and stay where they are
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("posexplode(labels")]


def test_texts_of_items_are_made_once(spark, tmp_path):
    """Neither the filter of valid items nor the choices of an item repeat the work on its texts."""
    plan = queries.prompt_sequences(spark, _corpus_of(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1
    assert plan.index("posexplode") < plan.index("Answer:")  # upper nodes come first
