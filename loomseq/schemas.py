"""Explicit schemas of every table the package reads or writes.

Nothing is inferred: sources pass these to ``spark.read.schema``.
"""

from pyspark.sql import types as T

CORPUS = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("text", T.StringType(), True),
])

DOC_TOKENS = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("tokens", T.ArrayType(T.IntegerType(), False), True),
])

DOC_INDEX = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("shard_idx", T.LongType(), False),
    T.StructField("doc_ix", T.LongType(), False),
    T.StructField("start", T.LongType(), False),
    T.StructField("end", T.LongType(), False),
])

SHARD_INDEX = T.StructType([
    T.StructField("documents", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType(), False),
        T.StructField("end", T.LongType(), False),
    ]), False), False),
    T.StructField("num_tokens", T.LongType(), False),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
])

SHARD_ROWS = T.StructType([
    T.StructField("shard_idx", T.LongType(), False),
    T.StructField("doc_ix", T.LongType(), False),
    T.StructField("tokens", T.ArrayType(T.IntegerType(), False), False),
])

SHARD_MANIFEST = T.StructType([
    T.StructField("shard_idx", T.LongType(), False),
    T.StructField("stem", T.StringType(), False),
    T.StructField("documents", T.LongType(), False),
    T.StructField("num_tokens", T.LongType(), False),
])

PACKED = T.StructType([
    T.StructField("epoch", T.IntegerType(), False),
    T.StructField("shard_idx", T.LongType(), False),
    T.StructField("rank", T.IntegerType(), False),
    T.StructField("seq_ix", T.LongType(), False),
    T.StructField("tokens", T.ArrayType(T.IntegerType(), False), False),
])

SEQUENCES = T.StructType([
    T.StructField("epoch", T.IntegerType(), True),
    T.StructField("shard_idx", T.LongType(), True),
    T.StructField("rank", T.IntegerType(), True),
    T.StructField("bin", T.LongType(), True),
    T.StructField("tokens", T.ArrayType(T.IntegerType()), True),
])

# closed tells full sequences from open rests
STREAM_PLAN = T.StructType([
    T.StructField("epoch", T.IntegerType(), True),
    T.StructField("shard_idx", T.LongType(), True),
    T.StructField("rank", T.IntegerType(), True),
    T.StructField("bin", T.LongType(), True),
    T.StructField("ord", T.IntegerType(), True),
    T.StructField("doc_id", T.LongType(), True),
    T.StructField("len", T.LongType(), True),
    T.StructField("seq_start", T.LongType(), True),
    T.StructField("closed", T.BooleanType(), True),
])

MULTIPLE_CHOICE = T.StructType([
    T.StructField("subject", T.StringType(), True),
    T.StructField("item_id", T.LongType(), False),
    T.StructField("question", T.StringType(), True),
    T.StructField("choices", T.ArrayType(T.StringType()), True),
    T.StructField("options", T.ArrayType(T.StringType()), True),
    T.StructField("answer", T.StringType(), True),
    T.StructField("answer_is_text", T.BooleanType(), True),
])

CHOICE_LOGP = T.StructType([
    T.StructField("item_id", T.LongType(), False),
    T.StructField("choice_idx", T.LongType(), False),
    T.StructField("pos", T.LongType(), False),
    T.StructField("label", T.IntegerType(), False),
    T.StructField("logp", T.DoubleType(), True),
])

PREDICTIONS = T.StructType([
    T.StructField("seq_id", T.LongType(), False),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("token", T.IntegerType(), False),
    T.StructField("label", T.IntegerType(), False),
    T.StructField("pred", T.IntegerType(), True),
    T.StructField("logp", T.DoubleType(), True),
])

METRICS = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("step", T.LongType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("value", T.DoubleType(), True),
])
