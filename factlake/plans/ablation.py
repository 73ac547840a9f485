"""Experiment over a grid of configurations, resumable.

Retrieval runs once per model and chunking at the largest k: distances depend
on neither k nor temperature, so a smaller k only cuts the ranked list.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions.prompt import SYSTEM_PROMPT, build_context, context_budget, fill_prompt
from factlake.operators.evaluate import (
    classification_metrics,
    mean_latency,
    round_metrics,
)
from factlake.operators.grid import pending_configs
from factlake.operators.ivf import ListIndex
from factlake.operators.scale import MAX_BROADCAST_ROWS, has_at_most, materialize
from factlake.operators.scoring import (
    Scorer,
    collect_neighbours,
    outcomes,
    parse_scores,
    score,
    vote,
)
from factlake.plans.verify import nearest_documents
from factlake.schemas import results_schema
from factlake.sources.files import is_committed
from factlake.sources.tables import append_results

Variant = tuple[str, str]


def retrieve_variants(
    queries: dict[str, DataFrame],
    kbs: dict[Variant, DataFrame],
    k: int,
    exclude_own: bool = False,
    columns: Sequence[str] = (),
    indexes: dict[Variant, ListIndex] | None = None,
    store: str | None = None,
) -> DataFrame:
    """embedding, chunking, query_id, docs for every variant; `queries` holds
    the query vectors of each model, which are written down once. A variant
    with an index is searched by its lists. With a `store` every variant's
    neighbours are written there as soon as they are found, and a variant that
    was finished there is not searched again: a store is for one run and its
    resumptions, over the same articles and vectors."""
    parts = []
    spark = next(iter(kbs.values())).sparkSession
    folders = {v: store and _folder(store, v, k, exclude_own, columns, indexes) for v in kbs}
    open_ = [v for v, path in folders.items() if not path or not is_committed(spark, path)]
    asked = {model: materialize(queries[model], "queries") for model in {m for m, _ in open_}}
    for variant, path in folders.items():
        embedding, chunking = variant
        if variant in open_:
            index = (indexes or {}).get(variant)
            found = nearest_documents(asked[embedding], kbs[variant], k, exclude_own, columns, index)
            if path:
                found.write.mode("overwrite").parquet(path)
        if path:
            found = spark.read.parquet(path)
        parts.append(
            found.withColumns(
                {"embedding": F.lit(embedding), "chunking": F.lit(chunking)}
            )
        )
    every = reduce(DataFrame.unionByName, parts)
    return collect_neighbours(every, ["embedding", "chunking", "query_id"])


def _folder(store, variant, k, exclude_own, columns, indexes) -> str:
    """Where the neighbours of a variant are, by all that was asked for."""
    index = (indexes or {}).get(variant)
    asked = [*variant, k, exclude_own, *columns, index and index.probes]
    return f"{store.rstrip('/')}/{md5(repr(asked).encode()).hexdigest()}"


def _small(grid: DataFrame) -> DataFrame:
    return F.broadcast(grid) if has_at_most(grid, MAX_BROADCAST_ROWS) else grid


def with_configs(retrieved: DataFrame, grid: DataFrame) -> DataFrame:
    """Every configuration's share of the neighbours: the first k of its
    variant. The grid is broadcast if it is a small table, which is counted."""
    return retrieved.join(_small(grid), ["embedding", "chunking"]).withColumn(
        "docs", F.slice("docs", 1, F.col("top_k"))
    )


def vote_configs(retrieved: DataFrame, grid: DataFrame, max_distance: float = 1.0) -> DataFrame:
    """config_id, query_id, verdict of the built-in vote."""
    voted = vote(F.col("docs"), max_distance)
    return with_configs(retrieved, grid).select(
        "config_id",
        "query_id",
        voted["label"].alias("verdict"),
        F.lit(True).alias("is_valid"),
        F.lit(None).cast("double").alias("latency_sec"),
    )


def score_configs(
    retrieved: DataFrame,
    news: DataFrame,
    grid: DataFrame,
    scorer: Scorer,
    context_cap: int = 8192,
) -> DataFrame:
    """As `vote_configs`, but a user's model is asked: one call per
    configuration and article of (query_id, news)."""
    k, kind = F.col("top_k"), F.col("chunk_type")
    texts = F.transform("docs", lambda d: d["content"])
    request = (
        with_configs(retrieved, grid)
        .join(news, "query_id")
        .select(
            "config_id",
            "query_id",
            fill_prompt(build_context(texts), F.col("news")).alias("prompt"),
            context_budget(k, kind, F.lit(context_cap)).alias("num_ctx"),
            "temperature",
            "thinking",
            F.lit(SYSTEM_PROMPT).alias("system"),
        )
    )
    # Written down, so that no call is paid for twice.
    answers = score(request, scorer).drop("prompt", "system")
    return parse_scores(materialize(answers, "answers"))


def summarise(predictions: DataFrame, truth: DataFrame, grid: DataFrame) -> DataFrame:
    """One results row per configuration that has a scored row."""
    rows = outcomes(truth.withColumnRenamed("doc_id", "query_id"), predictions, "query_id")
    latency = mean_latency().alias("latency_mean_sec")
    metrics = classification_metrics(rows, ["config_id"], also=[latency])
    return round_metrics(metrics.join(_small(grid), "config_id"))


def run_ablation(
    grid: DataFrame,
    done: DataFrame | None,
    queries: dict[str, DataFrame],
    kbs: dict[Variant, DataFrame],
    truth: DataFrame,
    path: str | None = None,
    scorer: Scorer | None = None,
    max_distance: float = 1.0,
    exclude_own: bool = False,
    max_k: int = 10,
    context_cap: int = 8192,
    indexes: dict[Variant, ListIndex] | None = None,
    store: str | None = None,
) -> DataFrame:
    """Scores the configurations that `done` lacks; appends to the results at
    `path` when given. `truth` holds (doc_id, label) of the queries. `store` is
    a folder of neighbours for a run that may be resumed, see
    `retrieve_variants`."""
    todo = grid if done is None else pending_configs(grid, done)
    if scorer is None:
        retrieved = retrieve_variants(queries, kbs, max_k, exclude_own, indexes=indexes, store=store)
        predictions = vote_configs(retrieved, todo, max_distance)
    else:
        retrieved = retrieve_variants(queries, kbs, max_k, exclude_own, ("content",), indexes, store)
        news = next(iter(queries.values())).select("query_id", "news")
        predictions = score_configs(retrieved, news, todo, scorer, context_cap)
    table = summarise(predictions, truth, todo)
    if path is not None:
        append_results(table.select(*results_schema().names), path)
    return table
