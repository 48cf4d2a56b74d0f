"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose data and cores. Every query runs to the end into the no-op sink, after
one untimed run of the cheapest one to start the workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from loomseq.plans import queries
from loomseq.session import configure

HEADLINE = (
    "tokenize_docs", "shard_assign", "doc_shuffle_rank", "pack_bins", "packed_sequences", "packing_loss",
    "sequence_summary", "structure_arrays", "attention_reach", "mask_block_occupancy", "masked_loss",
    "marker_accuracy", "encode_docs", "subject_accuracy", "scaled_scores", "log_softmax", "doc_slices",
    "raw_shard_round_trip", "stream_shard_assign", "mask_tiles", "logit_loss", "token_cap_early",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName("loomseq-bench"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = queries.registry()
    run(registry["shard_assign"](spark, sf_dir))
    times = {}
    for name in names:
        start = time.perf_counter()
        run(registry[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or list(HEADLINE))
