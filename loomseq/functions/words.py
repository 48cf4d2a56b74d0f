"""Text to ids on the JVM: whitespace words and the md5 word-hash tokenizer."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: ids of the word-hash tokenizer lie below this; the special ids follow it
WORD_HASH_SIZE = 32_000
MARKER_ID = 32_000
PAD_ID = 32_001
BOS_ID = 32_002

#: marks a position that takes no part in the loss
IGNORE_LABEL = -100


def words(text: Column) -> Column:
    """Non-blank whitespace-separated pieces; null text stays null."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Length of :func:`words` without building any id."""
    return F.size(words(text))


def hash_id(word: Column, size: int = WORD_HASH_SIZE) -> Column:
    """First 8 hex digits of the md5 of a word, modulo ``size``."""
    prefix = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint")
    return (prefix % F.lit(size)).cast("int")


def word_hash_tokens(text: Column, size: int = WORD_HASH_SIZE) -> Column:
    """``array<int>`` of word-hash ids; null text gives null."""
    return F.transform(words(text), lambda w: hash_id(w, size))


def strip(text: Column) -> Column:
    """Remove all Unicode blanks at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def title_text(name: Column) -> Column:
    """Underscores to blanks, every word capitalised."""
    return F.initcap(F.regexp_replace(F.trim(F.replace(name, F.lit("_"), F.lit(" "))), r"\s+", " "))


def join_ids(ids: Column) -> Column:
    """Array as comma-separated text, for comparison and hashing."""
    return F.array_join(F.transform(ids, lambda t: t.cast("string")), ",")
