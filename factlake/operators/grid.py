"""Experiment configurations: the grid, its numbering and what is left to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The grid of the published experiment.
EMBEDDINGS = ("EMB-A", "EMB-B")
CHUNKINGS = ("CHUNK-A", "CHUNK-B")
TEMPERATURES = (0.0, 0.3)
TOP_KS = (1, 3, 5, 10)
CHUNK_TYPE = {"CHUNK-A": "full", "CHUNK-B": "sliding"}
MODEL_NAMES = {"EMB-A": "mxbai-embed-large", "EMB-B": "nomic-embed-text"}


def _literals(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def expand_configs(
    df: DataFrame,
    embeddings: Sequence[str] = EMBEDDINGS,
    chunkings: Sequence[str] = CHUNKINGS,
    temperatures: Sequence[float] = TEMPERATURES,
    top_ks: Sequence[int] = TOP_KS,
    thinking: Sequence[bool] = (False,),
) -> DataFrame:
    """Every row once per configuration. The product is a chain of exploded
    literals, so nothing is joined; `config_id` counts from 1 in product order
    (embedding, chunking, temperature, top_k, thinking)."""
    axes = {
        "embedding": embeddings,
        "chunking": chunkings,
        "temperature": temperatures,
        "top_k": top_ks,
        "thinking": thinking,
    }
    number: Column = F.lit(0)
    for name, values in axes.items():
        df = df.select("*", F.posexplode(_literals(values)).alias(f"_{name}", name))
        number = number * len(values) + F.col(f"_{name}")
    df = df.withColumn("config_id", (number + 1).cast("int"))
    kind = F.when(F.col("chunking") == "CHUNK-A", "full").otherwise("sliding")
    return df.drop(*[f"_{n}" for n in axes]).withColumn("chunk_type", kind)


def config_grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """The configurations alone."""
    return expand_configs(spark.range(1).drop("id"), **axes)


def index_variants(
    df: DataFrame,
    models: Sequence[str] = EMBEDDINGS,
    chunkings: Sequence[str] = CHUNKINGS,
) -> DataFrame:
    """Every row once per embedding model and chunking."""
    return df.select("*", F.explode(_literals(models)).alias("embedding_model")).select(
        "*", F.explode(_literals(chunkings)).alias("chunking")
    )


def pending_configs(grid: DataFrame, results: DataFrame) -> DataFrame:
    """Configurations without a row in the results."""
    return grid.join(results.select("config_id").distinct(), "config_id", "left_anti")
