"""Results don't depend on how rows lie, and nothing leaves them unsaid."""

import pytest
from pyspark.sql import functions as F

from loomseq.functions import words as W
from loomseq.operators import evaluation as E, packing as P, vocabulary as Y
from loomseq.plans import jobs, queries
from loomseq.sources.corpus import read_corpus


def test_bins_of_a_table_read_again(spark, sf_dir, tmp_path):
    settings = queries.SETTINGS
    index = jobs.index_corpus(read_corpus(spark, f"{sf_dir}/documents.parquet"), settings)
    dealt = P.deal_documents(index, epochs=2, world_size=2, base_seed=1)
    dealt.repartition(7).write.parquet(str(tmp_path / "dealt"))
    pack = lambda df: sorted(map(tuple, P.pack_bins(df, sequence_length=1024, stride=7).collect()))
    want = pack(dealt)
    assert want and pack(spark.read.parquet(str(tmp_path / "dealt"))) == want


def test_items_without_log_probabilities_count(spark):
    items = spark.createDataFrame(
        [("s", i, "q", ["x", "y"], None, "A" if i % 2 else "B", True) for i in range(6)],
        "subject string, item_id long, question string, choices array<string>, options array<string>, answer string, answer_is_text boolean")
    logp = spark.createDataFrame([(i, c, 1, -1.0 - c) for i in range(3) for c in range(2)] + [(3, 1, 1, -5.0)],
                                 "item_id long, choice_idx int, label int, logp double")
    got = {r.item_id: r.pred_idx for r in E.graded_items(items, logp, max_items=None).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0, 5: 0}
    report = jobs.multiple_choice_report(items, logp, ["s"]).where("level = 1").first()
    assert report.total == 6
    many = spark.createDataFrame([("s", 1, "q", [str(k) for k in range(30)], None, "A", True)], items.schema)
    assert E.dropped_choices(E.valid_items(many)).collect() == [(1, 30, 4)]


def test_documents_without_words_stay(spark):
    corpus = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None)], "doc_id long, text string")
    words = Y.explode_words(corpus)
    vocab = Y.with_specials(Y.word_vocabulary(words))
    assert vocab.where("token IS NULL").count() == 0
    coded = Y.encode(words, vocab, unknown_id=-1)
    assert {r.doc_id for r in coded.where("id IS NULL").collect()} == {2, 3}
    ids = coded.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id")))).alias("c"))
    back = Y.decode(ids.select("doc_id", F.col("c.id").alias("tokens")), vocab)
    assert {r.doc_id: r.text for r in back.collect()} == {1: "b a b", 2: "", 3: ""}


def test_order_key_must_be_unique(spark):
    settings = jobs.SequenceSettings(tokens_per_shard=10, sequence_length=8)
    for ids in ((1, 1), (None, 2)):
        corpus = spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string")
        with pytest.raises(ValueError, match="unique"):
            jobs.index_corpus(corpus, settings)


def test_empty_documents_get_no_marker(spark, tmp_path):
    rows = [(1, "a b c"), (2, ""), (3, " \n"), (4, "x " * 9), (5, "x " * 7)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.maybe_append_marker(spark, str(tmp_path)).collect()}
    assert {i: (r.since, r.length) for i, r in got.items()} == {1: (3, 3), 2: (0, 0), 3: (0, 0), 4: (2, 10), 5: (7, 8)}
    assert got[2].last_id is None and got[3].last_id is None
    assert got[5].last_id == W.MARKER_ID and got[1].last_id not in (None, W.MARKER_ID)
