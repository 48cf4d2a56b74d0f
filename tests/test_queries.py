"""Registered queries against their SQL on the smallest tables.

All of them run with ``LOOMSEQ_ALL_QUERIES=1``; otherwise a spread of them does.
"""

import os

import pytest

import __spark_entry__ as entry
from loomseq.plans import oracle, queries
from oracle_check import compare, connect

SOME = ("sequence_summary", "shard_assign", "shard_index", "pack_bins", "packing_loss", "structure_arrays",
        "mask_block_occupancy", "mmlu_prompts", "mmlu_choices", "encode_docs", "decode_docs", "marker_accuracy", "subject_accuracy", "metric_log", "scaled_scores", "raw_shard_round_trip",
        "stream_shard_assign")
NAMES = tuple(queries.registry()) if os.environ.get("LOOMSEQ_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(queries.registry()) == set(oracle.statements())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, sf_dir, name):
    ok, note, *_ = compare(spark, db, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
