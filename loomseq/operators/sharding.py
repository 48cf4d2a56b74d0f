"""Corpus to token shards: caps, totals, shard cut, shard index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions import words as W
from ..functions.numeric import shard_stem
from ..session import materialise, spread_by
from .ordered import BLOCK_ROWS, BUCKET_WIDTH, FAN_IN, greedy_cut, prefix_sums


def spread(corpus: DataFrame, order: str = "doc_id") -> DataFrame:
    """Hash the corpus on its order key before tokenising.

    Tokenising then runs on all tasks whatever the file layout, and a join on the
    key needs no further exchange.
    """
    return spread_by(corpus.select(order, "text"), order)


def tokenize(corpus: DataFrame, tokenizer: Column | None = None, order: str = "doc_id") -> DataFrame:
    """``(doc_id, tokens)``; documents without a tokenisation are skipped, empty ones kept."""
    if tokenizer is None:
        return corpus.where(F.col("text").isNotNull()).select(
            order, W.word_hash_tokens(F.col("text")).alias("tokens"))
    return corpus.select(order, tokenizer.alias("tokens")).where(F.col("tokens").isNotNull())


def check_ids(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Fail on ids that do not fit an unsigned 31-bit range."""
    bad = F.exists(tokens, lambda t: (t < 0) | (t.cast("bigint") >= F.lit(2**31)))
    kind = docs.schema[tokens].dataType
    fail = F.raise_error(F.lit("token id outside [0, 2**31)")).cast(kind)
    return docs.withColumn(tokens, F.when(bad, fail).otherwise(F.col(tokens)))


def word_lengths(corpus: DataFrame, order: str = "doc_id") -> DataFrame:
    """``(doc_id, len)`` of the word tokenizer, without building ids."""
    return corpus.where(F.col("text").isNotNull()).select(order, W.word_count(F.col("text")).cast("bigint").alias("len"))


def token_lengths(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """``(doc_id, len)`` of a tokenised table."""
    return docs.where(F.col("tokens").isNotNull()).select(order, F.size("tokens").cast("bigint").alias("len"))


def sample_index(corpus: DataFrame, order: str = "doc_id", width: int = BUCKET_WIDTH) -> DataFrame:
    """0-based input position of every row; narrow tables only (it shuffles what it is given)."""
    return prefix_sums(corpus, order, {"sample_idx": "*"}, width=width)


def cap_samples(corpus: DataFrame, max_samples: int | None, order: str = "doc_id",
                width: int = BUCKET_WIDTH) -> DataFrame:
    """The first ``max_samples`` rows in input order, empty rows counted as well.

    Only the order key is ranked; the rows themselves are filtered by the key
    at which the cap is reached, so the text is not moved.
    """
    if max_samples is None:
        return corpus
    if max_samples <= 0:
        return corpus.where(F.lit(False))
    ranked = sample_index(corpus.select(order), order, width)
    last = ranked.where(F.col("sample_idx") < max_samples).agg(F.max(order))
    return corpus.where(F.col(order) <= last.scalar())


def running_lengths(lengths: DataFrame, order: str = "doc_id", width: int = BUCKET_WIDTH) -> DataFrame:
    """Non-empty documents with tokens before (``start``) and documents before (``rn``)."""
    return prefix_sums(lengths.where(F.col("len") > 0), order, {"start": "len", "rn": "*"}, width=width)


def cap_tokens(running: DataFrame, max_tokens: int | None) -> DataFrame:
    """Documents that begin before the cap; the one that crosses it stays. 0 or less is no cap."""
    if max_tokens is None or max_tokens <= 0:
        return running
    return running.where(F.col("start") < max_tokens)


def lengths_up_to_cap(
    corpus: DataFrame, max_tokens: int, *, size: str = "n_chars", order: str = "doc_id", slack: float = 1.1,
) -> tuple[DataFrame, int]:
    """Word counts of a beginning of the corpus that reaches the token cap, and how many texts were read for it.

    ``size`` is a column with the characters of each text, which bounds its words:
    they need a blank between them. Texts that this bound proves to begin before the
    cap are counted first; then the words a character gave so far say how far to
    go on, ``slack`` further, until the cap is reached. Only sizes of the
    whole table are read, and texts beyond the last step never.
    """
    sizes = materialise(prefix_sums(
        corpus.select(order, F.coalesce(F.col(size), F.lit(0)).alias("__size")), order, {"__before": "__size"}))
    parts, tokens, chars, read, last = [], 0, 0, 0, None
    per_token = 2.0  # a word and the blank behind it
    while True:
        reach = chars + max(int((max_tokens - tokens) * per_token), 1)
        rest = sizes if last is None else sizes.where(F.col(order) > last)
        # the document that crosses the reach is the last of the step
        step = rest.where(F.col("__before") < reach).agg(F.max(order), F.sum("__size")).first()
        if step[0] is None:
            break
        texts = corpus.where(F.col(order) <= step[0])
        part = materialise(word_lengths(texts if last is None else texts.where(F.col(order) > last), order))
        rows, found = part.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        parts.append(part)
        tokens, chars, read, last = tokens + found, chars + step[1], read + rows, step[0]
        if tokens >= max_tokens:
            break
        per_token = slack * chars / max(tokens, 1)
    whole = parts[0] if parts else word_lengths(corpus.limit(0), order)
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole, read


def assign_shards(
    lengths: DataFrame,
    tokens_per_shard: int,
    *,
    max_tokens: int | None = None,
    order: str = "doc_id",
    width: int = BUCKET_WIDTH,
    block_rows: int = BLOCK_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Document index ``(doc_id, shard_idx, doc_ix, start, end)`` of all token shards.

    A shard closes on the document that brings it to ``tokens_per_shard``. Keys
    and lengths are written down three times on the way (lengths, running totals,
    index), so the text is read once for all of it.
    """
    lengths = materialise(lengths)
    check_order_key(lengths, order)
    running = cap_tokens(running_lengths(lengths, order, width), max_tokens)
    cut = greedy_cut(materialise(running), tokens_per_shard, order=order, block_rows=block_rows, fan_in=fan_in)
    return materialise(cut.select(
        order, F.col("bin").alias("shard_idx"), F.col("ix").alias("doc_ix"), "start", "end"))


def check_order_key(df: DataFrame, order: str = "doc_id") -> None:
    """Refuse an order key that is null or not unique: running totals would depend on chance.

    Keys and counts only, combined before they move; give it a written table.
    """
    bad = df.groupBy(order).agg(F.count(F.lit(1)).alias("rows")).where(F.col(order).isNull() | (F.col("rows") > 1)).head()
    if bad is not None:
        raise ValueError(f"{order} must be unique and not null; found {bad[0]} in {bad['rows']} rows")


def run_totals(doc_index: DataFrame) -> DataFrame:
    """Documents, tokens and shards of a run."""
    return doc_index.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("tokens"),
        F.coalesce(F.max("shard_idx") + 1, F.lit(0)).alias("shards"),
    )


def skipped_documents(corpus: DataFrame) -> DataFrame:
    """Input rows left out of the shards: null text and text without tokens."""
    return corpus.agg(
        F.count_if(F.col("text").isNull()).alias("null_text"),
        F.count_if(W.word_count(F.col("text")) == 0).alias("empty_text"),
    )


def observe_corpus(corpus: DataFrame, docs: DataFrame | None = None) -> tuple[DataFrame, Observation]:
    """Token rows of a corpus, and totals that the action which reads them fills in on the way.

    The observation gives rows, null_text, empty_text, documents and tokens of what was
    read; writing the rows costs no further pass for its report.
    """
    found = Observation()
    tokens = W.word_hash_tokens(F.col("text")) if docs is None else F.col("tokens")
    rows = (corpus if docs is None else docs).select("doc_id", tokens.alias("tokens"))
    size = F.coalesce(F.size("tokens"), F.lit(0))
    observed = rows.observe(
        found, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("tokens").isNull()).alias("null_text"),
        F.count_if(F.size("tokens") == 0).alias("empty_text"), F.count_if(F.size("tokens") > 0).alias("documents"),
        F.coalesce(F.sum(F.when(F.col("tokens").isNotNull(), size)).cast("bigint"), F.lit(0)).alias("tokens"))
    return observed.where(F.size("tokens") > 0), found


def violations(corpus: DataFrame, docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """``(check, rows)``: rows of a corpus (order, text) and its token arrays (order, tokens) that break a rule.

    What :func:`check_order_key` and :func:`check_ids` refuse, as a report.
    """
    keys = corpus.groupBy(order).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.when(F.col(order).isNull(), F.col("n"))), F.lit(0)).alias("null_key"),
        F.coalesce(F.sum(F.when(F.col(order).isNotNull() & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("repeated_key"))
    texts = corpus.agg(F.count_if(F.col("text").isNull()).alias("null_text"))
    outside = F.exists("tokens", lambda t: t.isNull() | (t < 0) | (t.cast("bigint") >= F.lit(2**31)))
    ids = docs.agg(F.count_if(outside).alias("id_outside_range"), F.count_if(F.size("tokens") == 0).alias("no_tokens"))
    report = [t.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("rows")) for c in t.columns])))
              for t in (keys, texts, ids)]
    return report[0].unionByName(report[1]).unionByName(report[2])


def progress(lengths: DataFrame, every: int = 1_000, order: str = "doc_id", width: int = BUCKET_WIDTH) -> DataFrame:
    """Running totals at every ``every``-th sample (documents and tokens up to and including it)."""
    filled = lengths.withColumn("__one", (F.col("len") > 0).cast("bigint"))
    totals = prefix_sums(filled, order, {"sample_idx": "*", "docs": "__one", "toks": "len"}, width=width)
    return totals.where((F.col("sample_idx") + 1) % every == 0).select(
        (F.col("sample_idx") + 1).alias("samples"),
        (F.col("docs") + F.col("__one")).alias("documents"),
        (F.col("toks") + F.col("len")).alias("tokens"),
    )


def metadata_column(metadata: dict[str, str]) -> Column:
    """Literal ``map<string,string>``."""
    pairs = [F.lit(str(x)) for kv in metadata.items() for x in kv]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def shard_index(doc_index: DataFrame, metadata: dict[str, str], own: DataFrame | None = None) -> DataFrame:
    """One row per shard: stem, ordered document offsets, token count, metadata, JSON.

    ``own`` (shard_idx, own: map) adds metadata of each shard to the common one.
    """
    per_shard = doc_index.groupBy("shard_idx").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("documents"),
        F.sum(F.col("end") - F.col("start")).alias("num_tokens"),
    ).withColumn("metadata", metadata_column(metadata))
    if own is not None:
        per_shard = per_shard.join(own, "shard_idx", "left").withColumn(
            "metadata", F.when(F.col("own").isNull(), F.col("metadata")).otherwise(F.map_concat("metadata", "own")))
    return per_shard.select(
        "shard_idx",
        shard_stem(F.col("shard_idx")).alias("stem"),
        "documents", "num_tokens", "metadata",
        F.to_json(F.struct("documents", "num_tokens", "metadata")).alias("index_json"),
    )


def shard_document_id(shard_idx: Column, doc_ix: Column) -> Column:
    """One order key for a document known by its shard and its place there."""
    return F.shiftleft(shard_idx.cast("bigint"), 32) + doc_ix.cast("bigint")


def index_documents(index: DataFrame) -> DataFrame:
    """Document index back from shard index rows; empty documents stay, they take a turn."""
    rows = index.select("shard_idx", F.posexplode("documents").alias("doc_ix", "d"))
    return rows.select(
        shard_document_id(F.col("shard_idx"), F.col("doc_ix")).alias("doc_id"), "shard_idx",
        F.col("doc_ix").cast("bigint").alias("doc_ix"), F.col("d.start").alias("start"), F.col("d.end").alias("end"))


def dataset_metadata(index: DataFrame) -> DataFrame:
    """Metadata of the first shard (an empty map if it has none) and whether all shards agree."""
    text = F.to_json(F.col("metadata"))
    return index.agg(
        F.coalesce(F.min_by("metadata", "shard_idx"), F.create_map().cast("map<string,string>")).alias("metadata"),
        (F.coalesce(F.min(text), F.lit("")) == F.coalesce(F.max(text), F.lit(""))).alias("all_equal"),
    )


def slice_documents(shards: DataFrame, doc_index: DataFrame) -> DataFrame:
    """Cut documents out of flat shard arrays by their half-open offsets."""
    return shards.join(doc_index, "shard_idx").select(
        "shard_idx", "doc_ix",
        F.slice("tokens", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).alias("tokens"))


def shard_rows(doc_index: DataFrame, docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Token rows of all shards: the index joined back to the documents, tokens moved once."""
    return docs.join(doc_index.select(order, "shard_idx", "doc_ix"), order)
