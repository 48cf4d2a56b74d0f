"""Registered queries: every operator on the given tables.

Each callable takes ``(spark, sf_dir)``. Long results are folded to one row per
document or sequence, with arrays as comma-separated text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import markers as M
from ..functions import numeric as N
from ..functions import structure as A
from ..functions import vectors as V
from ..functions import words as W
from ..operators import evaluation as E
from ..operators import mask_tiles as T
from ..operators import metrics as X
from ..operators import packing as P
from ..operators import scores as C
from ..operators import pages as G
from ..operators import sharding as S
from ..operators import structure as L
from ..operators import vocabulary as Y
from ..session import materialise, new_folder, spread_by
from ..sources import metric_sink, raw_shards, shard_table
from ..sources.corpus import read_conversations, read_corpus, read_subjects, repeated_pair, stream_corpus
from ..streaming import jobs as R
from ..streaming import packing as Q
from . import fixtures, jobs

#: settings of all registered queries
SETTINGS = jobs.SequenceSettings(
    tokens_per_shard=16_384, sequence_length=1_024, stride=7, world_size=2, epochs=2, base_seed=42)
MAX_TOKENS = 100_000
MAX_SAMPLES = 150
KEY = list(L.SEQUENCE_KEY)
METADATA = {"dataset": "documents", "split": "train", "tokenizer": "word-md5", "max_tokens": "None"}

Query = Callable[[SparkSession, str], DataFrame]


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return read_corpus(spark, f"{sf}/documents.parquet")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _tokens(spark, sf) -> DataFrame:
    return S.tokenize(S.spread(_corpus(spark, sf)))


def _lengths(spark, sf) -> DataFrame:
    return materialise(S.word_lengths(_corpus(spark, sf)))


def _index(spark, sf) -> DataFrame:
    return jobs.index_corpus(_corpus(spark, sf), SETTINGS)


def _dealt(spark, sf) -> DataFrame:
    return P.deal_documents(_index(spark, sf), epochs=SETTINGS.epochs, world_size=SETTINGS.world_size,
                            base_seed=SETTINGS.base_seed)


def _bins(spark, sf) -> DataFrame:
    return jobs.plan_bins(_index(spark, sf), SETTINGS)


def _packed(spark, sf) -> DataFrame:
    return jobs.pack_corpus(_corpus(spark, sf), SETTINGS)


def _structured(spark, sf) -> DataFrame:
    return A.add_structure(_packed(spark, sf), marker_id=SETTINGS.marker_id, pad_id=SETTINGS.pad_id)


def _grouped(spark, sf) -> DataFrame:
    return L.with_groups(L.to_long(_packed(spark, sf)), marker_id=SETTINGS.marker_id, pad_id=SETTINGS.pad_id)


def _text(name: str) -> Column:
    return W.join_ids(F.col(name)).alias(name)


def _fold(long: DataFrame, *names: str) -> DataFrame:
    """One row per sequence with each column as text in position order."""
    cells = F.array_sort(F.collect_list(F.struct("pos", *names)))
    return long.groupBy(*KEY).agg(cells.alias("__c")).select(
        *KEY, *[W.join_ids(F.col(f"__c.{n}")).alias(n) for n in names])


# --- corpus and shards -------------------------------------------------------------------------

def tokenize_docs(spark, sf):
    return _tokens(spark, sf).select("doc_id", F.size("tokens").alias("n"), _text("tokens"))


def conversation_tokens(spark, sf):
    """The chat corpus: whole conversations, tokenised."""
    docs = S.tokenize(read_conversations(spark, f"{sf}/conversations.parquet"))
    return docs.select("doc_id", F.size("tokens").alias("n"), _text("tokens"))


def insert_markers(spark, sf):
    docs = _tokens(spark, sf).withColumn("tokens", M.insert_markers(F.col("tokens"), 7, W.MARKER_ID))
    return docs.select("doc_id", _text("tokens"))


def insert_markers_labels(spark, sf):
    docs = _tokens(spark, sf).withColumn("labels", F.transform("tokens", lambda t, i: (i % 2).cast("int")))
    tokens, labels = M.insert_markers_with_labels(F.col("tokens"), F.col("labels"), 5, W.MARKER_ID)
    return docs.select("doc_id", tokens.alias("tokens"), labels.alias("labels")).select(
        "doc_id", _text("tokens"), _text("labels"))


def wrap_documents(spark, sf):
    docs = _tokens(spark, sf).withColumn(
        "tokens", M.wrap_document(F.col("tokens"), 7, W.MARKER_ID, W.BOS_ID, W.PAD_ID))
    return docs.select("doc_id", _text("tokens"))


def sample_cap(spark, sf):
    return S.cap_samples(_corpus(spark, sf), MAX_SAMPLES).select("doc_id", F.length("text").alias("text_length"))


def token_cap(spark, sf):
    running = materialise(S.running_lengths(_lengths(spark, sf)))
    return S.cap_tokens(running, MAX_TOKENS).select("doc_id", "len", "start", "rn")


def capped_shards(spark, sf):
    return jobs.index_corpus(_corpus(spark, sf), SETTINGS, max_samples=MAX_SAMPLES, max_tokens=MAX_TOKENS // 4)


def shard_assign(spark, sf):
    return _index(spark, sf)


def shard_index(spark, sf):
    return S.shard_index(_index(spark, sf), METADATA).select("shard_idx", "stem", "num_tokens", "index_json")


def dataset_metadata(spark, sf):
    """Metadata of the first shard, the languages it holds among them, and whether all shards agree."""
    index = _index(spark, sf)
    langs = F.array_join(F.array_sort(F.collect_set("lang")), ",")
    own = index.join(_documents(spark, sf).select("doc_id", "lang"), "doc_id").groupBy("shard_idx").agg(
        F.create_map(F.lit("languages"), langs).alias("own"))
    meta = S.dataset_metadata(S.shard_index(index, METADATA, own))
    return meta.select(F.explode("metadata").alias("name", "value"), "all_equal")


def run_totals(spark, sf):
    return S.run_totals(_index(spark, sf))


def skipped_documents(spark, sf):
    return S.skipped_documents(_corpus(spark, sf))


def progress(spark, sf):
    return S.progress(_lengths(spark, sf), 100)


def doc_slices(spark, sf):
    """Documents cut back out of the pages of their shards."""
    index = _index(spark, sf)
    rows = _tokens(spark, sf).join(index.select("doc_id", "shard_idx", "start"), "doc_id")
    return G.slice_pages(G.page_shards(rows, 4_096), index, 4_096).select("shard_idx", "doc_ix", _text("tokens"))


def token_cap_early(spark, sf):
    """The same documents as ``token_cap``; texts behind the cap are not read."""
    lengths, _ = S.lengths_up_to_cap(_documents(spark, sf), MAX_TOKENS)
    return S.cap_tokens(materialise(S.running_lengths(lengths)), MAX_TOKENS).select("doc_id", "len", "start", "rn")


def observed_totals(spark, sf):
    """Totals of a token table, taken while it was written."""
    rows, found = S.observe_corpus(_corpus(spark, sf))
    rows.write.parquet(new_folder(spark, "tokens"))
    totals = found.get
    return spark.createDataFrame([tuple(totals.values())], ", ".join(f"{name} bigint" for name in totals))


def violations(spark, sf):
    """Rows of the corpus, taken twice over, that break a rule of keys, texts or ids."""
    corpus = _corpus(spark, sf)
    twice = corpus.unionByName(corpus.where(F.col("doc_id") % 3 == 0))
    return S.violations(twice, S.tokenize(twice))


def corpus_split(spark, sf):
    """One split of a corpus that is partitioned by language; the other folders are not read."""
    path = new_folder(spark, "corpus")
    _documents(spark, sf).select("doc_id", "text", F.col("lang").alias("split")).write.partitionBy("split").parquet(path)
    return read_corpus(spark, path, split="de").select("doc_id", F.length("text").alias("text_length"))


# --- packing -----------------------------------------------------------------------------------

def epoch_shard_order(spark, sf):
    return P.epoch_shard_order(_index(spark, sf), SETTINGS.epochs, SETTINGS.base_seed)


def doc_shuffle_rank(spark, sf):
    return _dealt(spark, sf).select("epoch", "shard_idx", "doc_ix", "doc_id", "place", "turn", "rank")


def pack_bins(spark, sf):
    return P.number_sequences(_bins(spark, sf)).select(
        "epoch", "shard_idx", "rank", "bin", "ord", "doc_id", "doc_ix", "len", "seq_ix")


def packed_sequences(spark, sf):
    return _packed(spark, sf).select(*KEY, _text("tokens"))


def rank_sequences(spark, sf):
    """Sequences of rank 1 in the order it yields them."""
    dealt = P.pick_rank(_dealt(spark, sf), 1)
    bins = materialise(P.pack_bins(dealt, sequence_length=SETTINGS.sequence_length, stride=SETTINGS.stride))
    packed = jobs.sequences(P.number_sequences(bins), _tokens(spark, sf), SETTINGS)
    return packed.select("epoch", "seq_ix", _text("tokens"))


def packing_loss(spark, sf):
    return P.packing_loss(_bins(spark, sf), sequence_length=SETTINGS.sequence_length, stride=SETTINGS.stride)


def packing_rest(spark, sf):
    """What every rank leaves in its open sequence of each shard."""
    dealt = materialise(_dealt(spark, sf))
    bins = P.pack_bins(dealt, sequence_length=SETTINGS.sequence_length, stride=SETTINGS.stride)
    return P.packing_rest(dealt, bins)


def pad_counts(spark, sf):
    return P.pad_counts(_packed(spark, sf), SETTINGS.pad_id).select(*KEY, "pads", "has_pads")


# --- structure ---------------------------------------------------------------------------------

def position_ids(spark, sf):
    return _fold(L.with_positions(_grouped(spark, sf)), "position_id", "segment_id")


def mask_groups(spark, sf):
    return _fold(_grouped(spark, sf), "mask_doc_id", "marker_group")


def since_last_marker(spark, sf):
    return _fold(L.with_since_marker(_grouped(spark, sf)), "since_marker")


def attention_reach(spark, sf):
    return _fold(L.with_reach(_grouped(spark, sf)), "reach")


def attention_reach_causal(spark, sf):
    return _fold(L.with_reach(_grouped(spark, sf)), "reach_causal")


def label_mask(spark, sf):
    long = L.with_labels(L.to_long(_packed(spark, sf)), SETTINGS.marker_id, SETTINGS.pad_id)
    return _fold(long, "label")


def structure_arrays(spark, sf):
    names = ("segment_id", "position_id", "mask_doc_id", "marker_group", "since_marker", "label", "reach",
             "reach_causal")
    return _structured(spark, sf).select(*KEY, *[_text(n) for n in names])


def distinct_segments(spark, sf):
    return L.distinct_segments(_grouped(spark, sf)).select(*KEY, _text("segments"))


def attention_edges(spark, sf):
    """Number of admitted keys of every sequence, the sum of their positions and the widest query."""
    keys = A.with_key_lists(_packed(spark, sf), marker_id=SETTINGS.marker_id, pad_id=SETTINGS.pad_id)
    return keys.select(
        *KEY,
        A.array_sum(F.transform("keys", lambda k: F.size(k))).alias("edges"),
        A.array_sum(F.transform("keys", lambda k: A.array_sum(k))).alias("key_sum"),
        F.array_max(F.transform("keys", lambda k: F.size(k))).alias("widest"))


def mask_block_occupancy(spark, sf):
    return L.mask_blocks_of(_packed(spark, sf), marker_id=SETTINGS.marker_id, pad_id=SETTINGS.pad_id, block=128)


def mask_block_occupancy_causal(spark, sf):
    return L.mask_blocks_of(
        _packed(spark, sf), marker_id=SETTINGS.marker_id, pad_id=SETTINGS.pad_id, block=128, use_markers=False)


#: reach of the sliding window of the mask queries
WINDOW = 200


def window_mask(q, k):
    """Causal within the document: the last ``WINDOW`` positions, and all markers; pads ask nothing."""
    near = (q["pos"] - k["pos"] < WINDOW) | k["is_marker"]
    return (q["pos"] >= k["pos"]) & (q["doc"] == k["doc"]) & near & ~q["is_pad"]


def _window_tiles(spark, sf) -> DataFrame:
    return T.with_tiles(_packed(spark, sf), window_mask, marker_id=SETTINGS.marker_id, pad_id=SETTINGS.pad_id)


def mask_tiles(spark, sf):
    """Tiles of a mask that only its predicate describes."""
    return T.masked_tiles(_window_tiles(spark, sf))


def mask_tile_skips(spark, sf):
    """How many tiles of that mask the zone map skipped or filled without looking at a cell."""
    return _window_tiles(spark, sf).drop("tiles")


def prefix_view(spark, sf):
    """Admitted keys among the first 256 positions of every sequence, the part a picture shows."""
    head = _packed(spark, sf).withColumn("tokens", F.slice("tokens", 1, 256))
    keys = A.with_key_lists(head, marker_id=SETTINGS.marker_id, pad_id=SETTINGS.pad_id)
    return keys.select(
        *KEY, F.size("tokens").alias("positions"), A.array_sum(F.transform("keys", lambda k: F.size(k))).alias("edges"),
        A.array_sum(F.transform("keys", lambda k: A.array_sum(k))).alias("key_sum"))


def sequence_summary(spark, sf):
    """Flagship: what every packed sequence holds and how far its queries reach."""
    s = _structured(spark, sf)
    pads, marks = M.count_id(F.col("tokens"), SETTINGS.pad_id), M.count_id(F.col("tokens"), SETTINGS.marker_id)
    return s.select(
        *KEY,
        F.size("tokens").alias("tokens"),
        (F.element_at("mask_doc_id", -1) + 1).alias("documents"),
        marks.alias("markers"), pads.alias("pads"),
        M.count_id(F.col("label"), W.IGNORE_LABEL).alias("masked_labels"),
        F.array_max("position_id").alias("longest_position"),
        A.array_sum(F.col("reach")).alias("reach_sum"),
        F.round(A.array_sum(F.col("reach")) / F.size("tokens"), 6).alias("mean_reach"))


# --- marker helpers ----------------------------------------------------------------------------

def maybe_append_marker(spark, sf):
    docs = _tokens(spark, sf).withColumn("tokens", M.insert_markers(F.col("tokens"), 7, W.MARKER_ID))
    done = docs.withColumn("since", M.tokens_since_last_marker(F.col("tokens"), W.MARKER_ID)).withColumn(
        "closed", M.maybe_append_marker(F.col("tokens"), W.MARKER_ID, 7))
    # get, not element_at: an empty document has no last id
    return done.select("doc_id", "since", F.size("closed").alias("length"), F.get("closed", F.size("closed") - 1).alias("last_id"))


def _prompts(spark, sf) -> DataFrame:
    """bos + prompt + choice with labels and markers, for every choice of every valid item."""
    docs = spread_by(_documents(spark, sf).select("doc_id", "source", "text"), "doc_id")
    items = E.valid_items(fixtures.multiple_choice(docs))
    # hashed before the choices unfold: once per item
    prompts = items.select("item_id", "ch", W.word_hash_tokens(E.format_prompt(F.col("question"), F.col("ch"))).alias("p"))
    coded = E.expand_choices(prompts).select("item_id", "choice_idx", "p", W.word_hash_tokens(F.col("completion")).alias("c"))
    tokens, labels = M.prompt_sequence(F.col("p"), F.col("c"), stride=7, marker_id=W.MARKER_ID, bos_id=W.BOS_ID)
    return coded.select("item_id", "choice_idx", tokens.alias("tokens"), labels.alias("labels"))


def prompt_sequences(spark, sf):
    return _prompts(spark, sf).select("item_id", "choice_idx", _text("tokens"), _text("labels"))


def choice_targets(spark, sf):
    """Positions of every prompt sequence whose next token belongs to the choice."""
    key = ["item_id", "choice_idx"]
    # the labels are hashed on the key as arrays, so that their rows needn't be moved once they are unfolded
    prompts = spread_by(_prompts(spark, sf).select(*key, "labels"), *key)
    found = X.choice_targets(prompts.select(*key, F.posexplode("labels").alias("pos", "label")), key=key)
    return found.select("item_id", "choice_idx", F.col("pos").cast("bigint").alias("pos"))


def repeated_pairs(spark, sf):
    docs = _tokens(spark, sf).withColumn(
        "tokens", M.insert_markers(F.concat(M.int_array(W.BOS_ID), F.col("tokens")), 7, W.MARKER_ID))
    return repeated_pair(docs, pad_id=W.PAD_ID, times=2).select("doc_id", "repeat", _text("tokens"))


def special_filter(spark, sf):
    """Special tokens per packed sequence, by semi join with the special ids."""
    names = ((SETTINGS.marker_id, "marker"), (SETTINGS.pad_id, "pad"), (SETTINGS.bos_id, "bos"))
    specials = spark.createDataFrame([(n, i, True) for i, n in names], "token string, id int, is_special boolean")
    kept = Y.keep_special(L.to_long(_packed(spark, sf)), specials)
    return kept.groupBy(*KEY, "token").agg(F.count(F.lit(1)).alias("n"))


def ordinary_filter(spark, sf):
    """Ordinary tokens per packed sequence, by anti join with the special ids."""
    names = ((SETTINGS.marker_id, "marker"), (SETTINGS.pad_id, "pad"), (SETTINGS.bos_id, "bos"))
    specials = spark.createDataFrame([(n, i, True) for i, n in names], "token string, id int, is_special boolean")
    kept = Y.keep_special(L.to_long(_packed(spark, sf)), specials, keep=False)
    return kept.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("token").alias("token_sum"))


# --- vocabulary --------------------------------------------------------------------------------

def _vocabulary(spark, sf) -> DataFrame:
    passages = spark.read.parquet(f"{sf}/benchmark.parquet")
    return Y.with_specials(Y.word_vocabulary(Y.explode_words(passages, "item_id")))


def vocabulary(spark, sf):
    return _vocabulary(spark, sf)


def special_ids(spark, sf):
    return Y.special_ids(_vocabulary(spark, sf)).select(_text("special_ids"))


def encode_docs(spark, sf):
    """Documents encoded with the benchmark vocabulary, unknown words counted."""
    coded = Y.encode(Y.explode_words(_corpus(spark, sf)), _vocabulary(spark, sf), unknown_id=-1)
    return coded.groupBy("doc_id").agg(
        F.count("token").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("id_sum"),
        F.count_if(F.col("id") == -1).alias("unknown"))


def encode_docs_skewed(spark, sf):
    """The same with the vocabulary joined as one too large to broadcast: frequent words apart from the rest."""
    coded = Y.encode(Y.explode_words(_corpus(spark, sf)), _vocabulary(spark, sf), unknown_id=-1, max_rows=0)
    return coded.groupBy("doc_id").agg(
        F.count("token").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("id_sum"),
        F.count_if(F.col("id") == -1).alias("unknown"))


def decode_docs(spark, sf):
    """Benchmark passages encoded, gathered and decoded again."""
    vocab = _vocabulary(spark, sf)
    words = Y.explode_words(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id")
    ids = Y.encode(words, vocab, unknown_id=-1).groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("c")).select(
        "item_id", F.col("c.id").alias("tokens"))
    return Y.decode(ids, vocab, "item_id")


# --- evaluation --------------------------------------------------------------------------------

def mmlu_prompts(spark, sf):
    items = E.valid_items(fixtures.multiple_choice(_documents(spark, sf)))
    return items.select("item_id", E.format_prompt(F.col("question"), F.col("ch")).alias("prompt"))


def mmlu_choices(spark, sf):
    items = E.expand_choices(E.valid_items(fixtures.multiple_choice(_documents(spark, sf))))
    return items.select("item_id", "choice_idx", "completion")


def mmlu_answers(spark, sf):
    items = E.valid_items(fixtures.multiple_choice(_documents(spark, sf)))
    read = items.select("item_id", E.answer_index(F.col("answer"), F.col("answer_is_text")).alias("answer_idx"))
    return read.where(F.col("answer_idx").isNotNull())


def first_items(spark, sf):
    return E.first_items(fixtures.multiple_choice(_documents(spark, sf)), 25).select("subject", "item_id")


def subject_items(spark, sf):
    """Items written by subject and read back for the wanted subjects, one of them absent."""
    path = new_folder(spark, "items")
    fixtures.multiple_choice(_documents(spark, sf)).write.partitionBy("subject").parquet(path)
    items = read_subjects(spark, path, fixtures.SUBJECTS)
    return items.groupBy("subject").agg(F.count(F.lit(1)).alias("items"), F.sum("item_id").alias("id_sum"))


def choice_scores(spark, sf):
    scores = E.choice_scores(fixtures.choice_logp(_documents(spark, sf)), "logp_milli")
    return scores.select("item_id", "choice_idx", F.col("score").cast("bigint").alias("score_milli"))


def best_choice(spark, sf):
    best = E.best_choice(E.choice_scores(fixtures.choice_logp(_documents(spark, sf)), "logp_milli"))
    return best.select("item_id", "pred_idx", F.col("score").cast("bigint").alias("score_milli"))


def subject_accuracy(spark, sf):
    docs = _documents(spark, sf)
    report = jobs.multiple_choice_report(
        fixtures.multiple_choice(docs), fixtures.choice_logp(docs), fixtures.SUBJECTS, max_items=25,
        value="logp_milli")
    return report.select(F.coalesce("subject", F.lit("overall")).alias("subject"), "correct", "total",
                         F.round("accuracy", 6).alias("accuracy"))


# --- metrics -----------------------------------------------------------------------------------

def _predictions(spark, sf) -> DataFrame:
    long = L.with_labels(L.to_long(_packed(spark, sf)), SETTINGS.marker_id, SETTINGS.pad_id)
    return fixtures.predictions(long, KEY)


def next_token_targets(spark, sf):
    return _fold(X.next_token_targets(L.to_long(_packed(spark, sf)), key=KEY), "target")


def shifted_labels(spark, sf):
    long = L.with_labels(L.to_long(_packed(spark, sf)), SETTINGS.marker_id, SETTINGS.pad_id)
    return _fold(X.shift_labels(long, key=KEY), "shifted_label")


def marker_accuracy(spark, sf):
    acc = X.marker_accuracy(_predictions(spark, sf), SETTINGS.marker_id, by=KEY, key=KEY)
    undefined = F.isnan("marker_accuracy")
    return acc.select(
        *KEY, undefined.alias("undefined"), F.when(~undefined, F.round("marker_accuracy", 6)).alias("marker_accuracy"))


def masked_loss(spark, sf):
    loss = X.masked_loss(_predictions(spark, sf), by=KEY, key=KEY, logp="logp_milli")
    return loss.select(*KEY, F.round("loss", 4).alias("loss_milli"))


def _measured(spark, sf) -> DataFrame:
    """Loss and marker accuracy per sequence as steps of its (epoch, rank) run."""
    bins = P.number_sequences(_bins(spark, sf))
    packed = jobs.sequences(bins, _tokens(spark, sf), SETTINGS)
    key = [*KEY, "seq_ix"]
    long = L.with_labels(L.to_long(packed, key), SETTINGS.marker_id, SETTINGS.pad_id)
    rows = fixtures.predictions(long, KEY)
    measured = X.step_metrics(
        rows, SETTINGS.marker_id, by=["epoch", "rank", "seq_ix"], key=KEY, logp="logp_milli")
    return measured.withColumnRenamed("seq_ix", "step")


def _metric_rows(steps: DataFrame) -> DataFrame:
    run = F.concat(F.lit("epoch"), F.col("epoch"), F.lit("-rank"), F.col("rank"))
    return X.to_metrics(steps, run, {
        "loss_milli": F.round("loss", 4), "ckpt_acc": F.round("marker_accuracy", 6)})


def metric_log(spark, sf):
    """Metric rows of the logged steps."""
    return _metric_rows(X.log_steps(_measured(spark, sf), 10))


# --- vectors -----------------------------------------------------------------------------------

def _vectors(spark, sf) -> DataFrame:
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    return v.select(N.int_div(F.col("vec_id"), 64).alias("seq"), F.pmod("vec_id", F.lit(64)).cast("int").alias("pos"),
                    F.col("embedding").alias("vec"))


def scaled_scores(spark, sf):
    """Causal scaled scores of 64-vector sequences with a distance penalty, folded per query."""
    rows = C.score_rows(
        _vectors(spark, sf), key=["seq"],
        score_mod=lambda s, q, k: s - F.lit(0.01) * (q["pos"] - k["pos"]),
        mask=lambda q, k: q["pos"] >= k["pos"])
    finite = F.filter("scores", lambda s: s > float("-inf"))
    return rows.select(
        "seq", "q_pos", F.size(finite).alias("keys"),
        F.round(F.aggregate(finite, F.lit(0.0), lambda a, x: a + x), 6).alias("score_sum"),
        F.round(F.array_max("scores"), 6).alias("best"), V.argmax(F.col("scores")).alias("best_key"))


def plain_scores(spark, sf):
    """Unmasked scaled scores with an explicit scale, folded per query."""
    rows = C.score_rows(_vectors(spark, sf), key=["seq"], scale=0.5)
    return rows.select("seq", "q_pos", F.size("scores").alias("keys"),
                       F.round(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x), 6).alias("score_sum"))


def log_softmax(spark, sf):
    v = V.with_log_softmax(spark.read.parquet(f"{sf}/embeddings.parquet"), "embedding", "logp")
    return v.select("vec_id", F.round(V.gather(F.col("logp"), F.col("label")), 6).alias("target_logp"),
                    F.round(F.aggregate("logp", F.lit(0.0), lambda a, x: a + x), 4).alias("logp_sum"))


def _logits_long(spark, sf) -> DataFrame:
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    return v.select("vec_id", F.posexplode("embedding").alias("token", "logit")).withColumn(
        "logit", F.col("logit").cast("double"))


def log_softmax_rows(spark, sf):
    """Long-form log-softmax gathered at each vector's label."""
    logp = C.log_softmax_long(_logits_long(spark, sf), key=["vec_id"])
    targets = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("label").alias("token"))
    got = C.gather_long(logp, targets, key=["vec_id"])
    return got.select("vec_id", "token", F.round("logp", 6).alias("target_logp"))


def logit_loss(spark, sf):
    """Loss per label straight from long logits."""
    logits = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        "vec_id", "label", F.posexplode("embedding").alias("token", "logit")).withColumn("logit", F.col("logit").cast("double"))
    loss = C.logit_loss(logits.withColumn("target", F.col("label")), by=["label"], key=["vec_id"])
    return loss.select("label", "positions", F.round("loss", 6).alias("loss"))


def vocab_argmax(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    return v.select("vec_id", V.argmax(F.col("embedding")).alias("pred"))


def vocab_argmax_rows(spark, sf):
    return C.argmax_long(_logits_long(spark, sf), key=["vec_id"])


# --- scalar helpers ----------------------------------------------------------------------------

def scalar_helpers(spark, sf):
    """Multiples, rounding, seeds, file names and titles over the documents table."""
    d = _documents(spark, sf).select("doc_id", "n_chars", "lang", "source")
    return d.select(
        "doc_id",
        N.floor_multiple(F.col("n_chars"), 128).alias("floor_128"),
        N.ceil_div(F.col("n_chars"), 128).alias("tiles"),
        N.ceil_div(-F.col("n_chars"), 128).alias("negative_tiles"),
        N.round_up(F.col("n_chars"), 128).alias("round_128"),
        N.epoch_seed(42, F.col("doc_id")).alias("epoch_seed"),
        N.document_seed(42, F.lit(3), F.col("doc_id")).alias("document_seed"),
        N.shard_stem(F.col("doc_id")).alias("stem"),
        W.title_text(F.concat(F.lit("attention_scores__"), F.col("lang"), F.lit("_"), F.col("source"))).alias("title"))


# --- files -------------------------------------------------------------------------------------

def _export(spark, sf) -> tuple[str, DataFrame]:
    path = new_folder(spark, "raw")
    rows = S.shard_rows(_index(spark, sf), _tokens(spark, sf))
    return path, raw_shards.export_raw_shards(rows, path, METADATA)


def raw_shard_round_trip(spark, sf):
    """All shards written as raw files and read back document by document."""
    path, _ = _export(spark, sf)
    return raw_shards.read_raw_shards(spark, path).select("shard_idx", "doc_ix", "start", "end", _text("tokens"))


def raw_shard_pick(spark, sf):
    """Some documents of every third shard; only the byte ranges they lie in are read."""
    path, _ = _export(spark, sf)
    shards = raw_shards.read_index(spark, path).agg(F.max("shard_idx")).first()[0]
    rows = raw_shards.read_raw_shards(spark, path, shards=range(0, shards + 1, 3), documents=(5, 20))
    return rows.select("shard_idx", "doc_ix", "start", "end", _text("tokens"))


def raw_shard_stream(spark, sf):
    """Raw shards that arrive in three parts, read by one stream that stops and goes on."""
    path, out = new_folder(spark, "raw"), new_folder(spark, "arrived")
    rows = materialise(S.shard_rows(_index(spark, sf), _tokens(spark, sf)))
    shards = rows.agg(F.max("shard_idx")).first()[0] + 1
    for part in range(3):
        raw_shards.write_raw_shards(rows.where(F.floor(3 * F.col("shard_idx") / shards) == part), path, METADATA)
        R.start_table(raw_shards.stream_raw_shards(spark, path), f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/table").select("shard_idx", "doc_ix", "start", "end", _text("tokens"))


def raw_shard_index(spark, sf):
    """Raw shard files discovered, paired and joined to their index and manifest."""
    path, manifest = _export(spark, sf)
    found = raw_shards.discover_shards(spark, path)
    index = raw_shards.read_index(spark, path)
    return found.join(index, "shard_idx").join(manifest.select("shard_idx", F.col("num_tokens").alias("written")),
                                               "shard_idx").select(
        "shard_idx", "stem", F.size("documents").cast("bigint").alias("documents"), "num_tokens", "written")


def raw_shard_sequences(spark, sf):
    """Sequences packed from raw shard files and their index."""
    path, _ = _export(spark, sf)
    packed = jobs.pack_shards(raw_shards.read_raw_shards(spark, path), raw_shards.read_index(spark, path), SETTINGS)
    return packed.select(*KEY, _text("tokens"))


def shard_table_round_trip(spark, sf):
    """Shards written as a Parquet table and read back with their index JSON."""
    path, index = new_folder(spark, "shards"), _index(spark, sf)
    shard_table.write_shards(S.shard_rows(index, _tokens(spark, sf)), f"{path}/tokens",
                             per_file=shard_table.shards_per_file(SETTINGS.tokens_per_shard))
    shard_table.write_index(S.shard_index(index, METADATA), f"{path}/index")
    parsed = shard_table.parse_index_json(spark.read.parquet(f"{path}/index").select("shard_idx", "index_json"))
    rows = shard_table.read_shards(spark, f"{path}/tokens").groupBy("shard_idx").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(A.array_sum(F.col("tokens"))).alias("token_sum"))
    return rows.join(parsed, "shard_idx").select(
        "shard_idx", "rows", "token_sum", F.size("documents").cast("bigint").alias("documents"), "num_tokens")


def metric_table(spark, sf):
    """Metric rows appended to the metric table and read back."""
    path = new_folder(spark, "metrics")
    metric_sink.write_metrics(metric_log(spark, sf), path)
    return metric_sink.read_metrics(spark, path)


# --- streaming ---------------------------------------------------------------------------------

def _stream(spark, sf) -> DataFrame:
    return stream_corpus(spark, f"{sf}/documents*.parquet")


def _drain(spark, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything there is and read the table it wrote."""
    path = new_folder(spark, name)
    query = R.start_table(stream, f"{path}/table", f"{path}/checkpoint")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def stream_tokenize(spark, sf):
    docs = _drain(spark, R.tokenize_stream(_stream(spark, sf)), "tokens")
    return docs.select("doc_id", F.size("tokens").alias("n"), _text("tokens"))


def _stream_cut(spark, sf) -> DataFrame:
    lengths = S.word_lengths(_stream(spark, sf)).withColumn("lane", F.lit(0))
    return _drain(spark, R.cut_stream(lengths, SETTINGS.tokens_per_shard), "cut")


def stream_shard_assign(spark, sf):
    return _stream_cut(spark, sf).select("doc_id", "shard_idx", "doc_ix", "start", "end")


def stream_pack_bins(spark, sf):
    """Documents dealt to ranks by their key and packed as they arrive."""
    dealt = S.word_lengths(_stream(spark, sf)).withColumn(
        "rank", F.pmod("doc_id", F.lit(SETTINGS.world_size)).cast("int"))
    return _drain(spark, R.pack_stream(dealt, SETTINGS.sequence_length, SETTINGS.stride), "pack")


def _stream_sequences(spark, sf) -> str:
    """Folder of the sequences packed by a stream that is stopped and started between arrivals."""
    out, shape = new_folder(spark, "sequences"), "epoch int, shard_idx bigint, rank int, turn bigint, doc_id bigint, len bigint"
    dealt = materialise(_dealt(spark, sf).select(
        "epoch", "shard_idx", "rank", F.col("turn").cast("bigint"), "doc_id", (F.col("end") - F.col("start")).alias("len")))
    _tokens(spark, sf).write.parquet(f"{out}/tokens")
    docs = spark.read.parquet(f"{out}/tokens")
    waves = [dealt.where((F.col("epoch") == e) & late) for e in range(SETTINGS.epochs) for late in (F.col("turn") < 20, F.col("turn") >= 20)]
    # the last arrival has no document; it moves the watermark past all timers
    waves.append(spark.createDataFrame([(-1, -1, -1, 0, -1, 0)], shape))
    for number, wave in enumerate(waves):
        at = 60 * (number + 1) if number + 1 < len(waves) else 86_400
        wave.withColumn("arrived", F.timestamp_seconds(F.lit(at))).write.mode("append").parquet(f"{out}/dealt")
        arriving = spark.readStream.schema(f"{shape}, arrived timestamp").parquet(f"{out}/dealt")
        plan = Q.pack_stream_until(
            arriving, sequence_length=SETTINGS.sequence_length, stride=SETTINGS.stride, timeout="90 seconds")
        Q.start_sequences(
            plan, docs, out, f"{out}/checkpoint", sequence_length=SETTINGS.sequence_length, stride=SETTINGS.stride,
            marker_id=SETTINGS.marker_id, bos_id=SETTINGS.bos_id, pad_id=SETTINGS.pad_id).awaitTermination()
    return out


def stream_packed_sequences(spark, sf):
    """Token arrays of the sequences that a stream of dealt documents closes."""
    return Q.read_sequences(spark, _stream_sequences(spark, sf)).select(*KEY, _text("tokens"))


def stream_packing_rest(spark, sf):
    """What the same stream gives out as open rests once the watermark has passed."""
    return Q.open_rests(Q.read_plan(spark, _stream_sequences(spark, sf)))


def _broken_off(each, after: int):
    """``each``, failing once when it has written batch ``after`` and before the stream records that."""
    failed = []

    def run(rows, batch_id):
        each(rows, batch_id)
        if batch_id == after and not failed:
            failed.append(batch_id)
            raise RuntimeError(f"broken off after batch {batch_id} was written")

    return run


def stream_metric_log(spark, sf):
    """Metric rows logged by a stream that breaks off after a batch was written, and replays it."""
    path = new_folder(spark, "metrics")
    rows = materialise(_metric_rows(_measured(spark, sf)))
    rows.repartition(4, "step").write.parquet(f"{path}/in")
    stream = X.log_steps(
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), 10)
    each = _broken_off(lambda batch, n: metric_sink.log_batch(batch, f"{path}/out", "metrics", n), after=1)
    try:
        R.start_batches(stream, each, f"{path}/checkpoint").awaitTermination()
    except StreamingQueryException:
        R.start_batches(stream, each, f"{path}/checkpoint").awaitTermination()
    return metric_sink.read_logged(spark, f"{path}/out")


ALL: tuple[Query, ...] = (
    sequence_summary,
    tokenize_docs, conversation_tokens, insert_markers, insert_markers_labels, wrap_documents, sample_cap, token_cap, capped_shards,
    shard_assign, shard_index, dataset_metadata, run_totals, skipped_documents, progress, doc_slices,
    epoch_shard_order, doc_shuffle_rank, pack_bins, packed_sequences, rank_sequences, packing_loss, packing_rest, pad_counts,
    position_ids, mask_groups, since_last_marker, attention_reach, attention_reach_causal, label_mask,
    structure_arrays, distinct_segments, attention_edges, prefix_view, mask_block_occupancy,
    mask_block_occupancy_causal, mask_tiles, mask_tile_skips, token_cap_early, observed_totals, violations, corpus_split,
    encode_docs_skewed, logit_loss, choice_targets,
    maybe_append_marker, prompt_sequences, repeated_pairs, special_filter, ordinary_filter,
    vocabulary, special_ids, encode_docs, decode_docs,
    mmlu_prompts, mmlu_choices, mmlu_answers, first_items, subject_items, choice_scores, best_choice, subject_accuracy,
    next_token_targets, shifted_labels, marker_accuracy, masked_loss, metric_log,
    scaled_scores, plain_scores, log_softmax, log_softmax_rows, vocab_argmax, vocab_argmax_rows,
    scalar_helpers,
    raw_shard_round_trip, raw_shard_pick, raw_shard_stream, raw_shard_index, raw_shard_sequences, shard_table_round_trip, metric_table,
    stream_tokenize, stream_shard_assign, stream_pack_bins, stream_packed_sequences, stream_packing_rest, stream_metric_log,
)


def registry() -> dict[str, Query]:
    return {q.__name__: q for q in ALL}
