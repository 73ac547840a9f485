"""Table schemas. Every read states its schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

NEWS = T.StructType(
    [
        T.StructField("source_index", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("split", T.StringType()),
    ]
)

KB = T.StructType(
    [
        T.StructField("source_index", T.LongType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("label", T.ShortType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("chunking", T.StringType()),
    ]
)

AUDIT = T.StructType(
    [
        T.StructField("news_content", T.StringType()),
        T.StructField("retrieved_docs", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("llm_reasoning", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

_METRICS = ["accuracy", "precision", "recall", "f1"]


def results_schema(with_specificity: bool = False) -> T.StructType:
    names = ["accuracy", "precision", "recall"]
    names += ["specificity"] if with_specificity else []
    names += ["f1", "latency_mean_sec"]
    return T.StructType(
        [
            T.StructField("config_id", T.IntegerType()),
            T.StructField("embedding", T.StringType()),
            T.StructField("chunking", T.StringType()),
            T.StructField("top_k", T.IntegerType()),
            T.StructField("temperature", T.DoubleType()),
            T.StructField("thinking", T.BooleanType()),
        ]
        + [T.StructField(n, T.DoubleType()) for n in names]
    )


COMPARISON = T.StructType(
    [T.StructField("system", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in _METRICS + ["latency_mean_sec"]]
)
