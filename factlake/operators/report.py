"""Tables of the experiment report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.operators.grid import MODEL_NAMES
from factlake.schemas import results_schema

# Highlighted configurations, the zone of preferred ones, marker
# shapes and sizes, and the published row of the system comparison.
BEST_CONFIG = 17
MAIN_CONFIG = 2
CONTEXT_ERROR_CONFIGS = (4, 8, 20, 24)
ZONE_LATENCY = (0.0, 110.0)
ZONE_F1 = 0.68
MARKERS = {"CHUNK-A": "o", "CHUNK-B": "s"}
MARKER_SIZES = {1: 60, 3: 100, 5: 140, 10: 200}
PUBLISHED_ROW = ("Nezafat & Samet (2024)*", 0.88, 0.94, None, 0.87, None)

MEANS = ["accuracy", "precision", "recall", "f1", "latency_mean_sec"]


def drop_unscored(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["f1"])


def with_model_name(df: DataFrame) -> DataFrame:
    """embedding, top_k, temperature become emb_id, k, T; `embedding` is then
    the model's name."""
    renamed = df.withColumnsRenamed({"embedding": "emb_id", "top_k": "k", "temperature": "T"})
    name = F.when(F.col("emb_id") == "EMB-A", MODEL_NAMES["EMB-A"]).otherwise(MODEL_NAMES["EMB-B"])
    return renamed.withColumn("embedding", name)


def with_specificity_layout(df: DataFrame) -> DataFrame:
    return df.select(*results_schema(with_specificity=True).names)


def categorise_config(df: DataFrame) -> DataFrame:
    c = F.col("config_id")
    category = (
        F.when(c == BEST_CONFIG, "best")
        .when(c == MAIN_CONFIG, "principal")
        .when(c.isin(*CONTEXT_ERROR_CONFIGS), "context-error")
        .otherwise(F.concat_ws("/", "embedding", "chunking"))
    )
    return df.withColumn("category", category)


def preferred_zone(df: DataFrame, f1_floor: float = ZONE_F1) -> DataFrame:
    low, high = ZONE_LATENCY
    return df.filter(F.col("latency_mean_sec").between(low, high) & (F.col("f1") >= f1_floor))


def pick_configs(df: DataFrame, ids: Sequence[int] = (MAIN_CONFIG, BEST_CONFIG)) -> DataFrame:
    return df.filter(F.col("config_id").isin(*ids))


def _lookup(column: str, values: dict) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.col(column))


def style_columns(df: DataFrame) -> DataFrame:
    marker = F.when(F.col("chunking") == "CHUNK-A", MARKERS["CHUNK-A"]).otherwise(MARKERS["CHUNK-B"])
    return df.withColumns({"marker": marker, "marker_size": _lookup("top_k", MARKER_SIZES)})


def _means() -> list[Column]:
    return [F.avg(c).alias(c) for c in MEANS]


def summary_by(df: DataFrame, column: str, digits: int = 4) -> DataFrame:
    """Mean metrics by one hyperparameter."""
    means = drop_unscored(df).groupBy(column).agg(*_means())
    return means.withColumns({c: F.round(c, digits) for c in MEANS})


def summary_all(df: DataFrame, digits: int = 4) -> DataFrame:
    """The four one-parameter summaries in one pass: hyperparameter, value."""
    axes = ["embedding", "chunking", "top_k", "temperature"]
    sets = [[F.col(a)] for a in axes]
    grouped = drop_unscored(df).groupingSets(sets, *axes).agg(
        *_means(), *[F.grouping(a).alias(f"_{a}") for a in axes]
    )
    name = F.coalesce(*[F.when(F.col(f"_{a}") == 0, F.lit(a)) for a in axes])
    value = F.coalesce(*[F.when(F.col(f"_{a}") == 0, F.col(a).cast("string")) for a in axes])
    return grouped.select(
        name.alias("hyperparameter"),
        value.alias("value"),
        *[F.round(c, digits).alias(c) for c in MEANS],
    )


def f1_by_group(df: DataFrame) -> DataFrame:
    """Mean F1 and the configurations behind it, by embedding, chunking, k."""
    return df.groupBy("embedding", "chunking", "top_k").agg(
        F.avg("f1").alias("f1"), F.array_sort(F.collect_set("config_id")).alias("config_ids")
    )


def flag_context_errors(
    groups: DataFrame, ids: Sequence[int] = CONTEXT_ERROR_CONFIGS
) -> DataFrame:
    wanted = F.array(*[F.lit(i) for i in ids])
    return groups.withColumn("has_error", F.arrays_overlap("config_ids", wanted))


def best_k(df: DataFrame) -> DataFrame:
    """The k with the largest mean F1, the smaller k in a tie."""
    means = df.groupBy("top_k").agg(F.avg("f1").alias("f1"))
    return means.orderBy(F.desc("f1"), "top_k").limit(1)


def sort_results(df: DataFrame, by: str = "config_id") -> DataFrame:
    return df.orderBy(by)


def comparison_table(*systems: DataFrame) -> DataFrame:
    """One table from the rows of several systems; what one lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), systems)
