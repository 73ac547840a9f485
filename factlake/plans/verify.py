"""Verification of a batch of articles against the knowledge base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.functions.prompt import (
    SYSTEM_PROMPT,
    build_context,
    context_budget,
    context_overflow,
    fill_prompt,
    format_duration,
)
from factlake.operators.ivf import ListIndex, ivf_search
from factlake.operators.scale import materialize, skew_join
from factlake.operators.scoring import (
    ANSWER,
    Scorer,
    collect_neighbours,
    parse_scores,
    score,
    vote,
)
from factlake.operators.similarity import similarity_join
from factlake.settings import Settings


def nearest_documents(
    queries: DataFrame,
    kb: DataFrame,
    k: int,
    exclude_own: bool = False,
    columns: Sequence[str] = ("content",),
    index: ListIndex | None = None,
) -> DataFrame:
    """The k nearest rows of every query with some of their columns. These are
    joined by id after the top-k, so that only ids, labels and vectors take
    part in the search; the found ids (k per query) are written down first, as
    the search is the costly part. One article may be near to many queries:
    such ids are split. With an `index` only the lists nearest to a query are
    searched; without one, all of `kb`."""
    if index is None:
        found = similarity_join(queries, kb, k, exclude_own)
    else:
        found = ivf_search(queries, kb, index.centroids, index.probes, k, exclude_own)
    if columns:
        found = materialize(found, "neighbours")
        found = skew_join(found, kb.select("vec_id", *columns), "vec_id", "query_id")
    return found.select("query_id", "rank", "vec_id", *columns, "label", "distance")


def retrieve(
    queries: DataFrame,
    kb: DataFrame,
    k: int,
    exclude_own: bool = False,
    index: ListIndex | None = None,
) -> DataFrame:
    """query_id and `docs`: content, label, distance of its neighbours."""
    return collect_neighbours(nearest_documents(queries, kb, k, exclude_own, index=index))


def with_prompts(queries: DataFrame, retrieved: DataFrame, settings: Settings) -> DataFrame:
    """Adds the retrieved documents, the filled prompt and the context window
    to (query_id, news, top_k). An article without any neighbour keeps an empty
    context."""
    k, kind = F.col("top_k"), F.lit(settings.chunk_type)
    cap = F.lit(settings.context_cap)
    docs = F.slice("docs", F.lit(1), k).alias("docs")
    found = queries.join(retrieved, "query_id", "left").select(*queries.columns, docs)
    texts = F.transform(F.coalesce("docs", F.array()), lambda d: d["content"])
    return found.withColumns(
        {
            "prompt": fill_prompt(build_context(texts), F.col("news")),
            "num_ctx": context_budget(k, kind, cap),
            "overflow": context_overflow(k, kind, cap),
        }
    )


def vote_json(docs: Column, max_distance: float = 1.0) -> Column:
    """The built-in vote as the JSON text a model would return."""
    return F.to_json(vote(docs, max_distance))


def asked_articles(queries: DataFrame, settings: Settings) -> DataFrame:
    """The articles, written down: their encoder is a user's model, and no
    call of it is to be made twice. `top_k` and `temperature` may be columns;
    where they are missing or NULL the settings hold."""
    own = {"top_k": ("int", settings.top_k), "temperature": ("double", settings.temperature)}
    given = {
        name: F.coalesce(F.col(name).cast(kind), F.lit(value)) if name in queries.columns else F.lit(value)
        for name, (kind, value) in own.items()
    }
    return materialize(queries.withColumns(given), "articles")


# What a scorer gets of each article.
REQUEST = ["query_id", "system", "prompt", "num_ctx", "temperature", "thinking"]


def verify(
    queries: DataFrame,
    kb: DataFrame,
    settings: Settings,
    scorer: Scorer | None = None,
    exclude_own: bool = False,
    index: ListIndex | None = None,
) -> DataFrame:
    """One row per article of (query_id, news, embedding): retrieved documents,
    prompt, verdict, confidence, reasoning, what the model thought, seconds of
    the call and since the start, as numbers and as text, and the error of a
    failed row. Without a `scorer` the neighbours vote. Encoder and scorer are
    called once per article: what they say is written down before it is used."""
    queries = asked_articles(queries, settings)
    least, k = queries.agg(F.min("top_k"), F.max("top_k")).first()
    if least is None:  # no articles
        least = k = settings.top_k
    if least < 1:
        raise ValueError("top_k must be at least 1")
    retrieved = retrieve(queries, kb, k, exclude_own, index)
    asked = with_prompts(queries.select("query_id", "news", "top_k", "temperature"), retrieved, settings)
    if scorer is None:
        none = {f.name: F.lit(None).cast(f.dataType) for f in ANSWER}
        scored = asked.withColumns(none | {"raw": vote_json(F.coalesce("docs", F.array()))})
    else:
        request = asked.withColumns(
            {"system": F.lit(SYSTEM_PROMPT), "thinking": F.lit(settings.thinking)}
        )
        scored = score(request, scorer, request=REQUEST).drop("system", "thinking")
        scored = materialize(scored, "answers")
    return parse_scores(scored).withColumnsRenamed({"thought": "thinking"}).withColumns(
        {
            "time_elapsed": format_duration(F.col("elapsed_sec")),
            "time_elapsed_llm": format_duration(F.col("latency_sec")),
        }
    )
