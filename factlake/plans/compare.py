"""Baseline, retrieval and a published row in one table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions.text import compose_document
from factlake.operators.evaluate import classification_metrics, mean_latency
from factlake.operators.ivf import ListIndex
from factlake.operators.report import PUBLISHED_ROW, comparison_table
from factlake.operators.sampling import class_sample, shuffle_rows
from factlake.operators.scale import materialize
from factlake.operators.scoring import Encoder, Scorer, embed, outcomes
from factlake.plans.baseline import BaselineRun, run_baseline
from factlake.plans.verify import verify
from factlake.schemas import COMPARISON
from factlake.settings import Settings

_QUALITY = ["accuracy", "precision", "recall", "f1"]


def system_row(name: str, rows: DataFrame, latency: float | None = None) -> DataFrame:
    """One row from (y_true, y_pred, latency_sec), to four digits; a given
    latency is kept to six."""
    mean = F.round(mean_latency(), 4) if latency is None else F.max(F.lit(round(latency, 6)))
    row = classification_metrics(rows, also=[mean.alias("latency_mean_sec")])
    quality = [F.round(c, 4).alias(c) for c in _QUALITY]
    return row.select(F.lit(name).alias("system"), *quality, "latency_mean_sec")


def published_row(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([PUBLISHED_ROW], COMPARISON)


@dataclass(frozen=True)
class Comparison:
    """Both systems on one sample: their rows, and the table of all."""

    baseline: BaselineRun
    verified: DataFrame
    sample: DataFrame
    table: DataFrame


def compare_on_sample(
    train: DataFrame,
    test: DataFrame,
    per_class: int,
    vectors: DataFrame,
    dim: int,
    lexicon: DataFrame,
    encoder: Encoder,
    settings: Settings,
    scorer: Scorer | None = None,
    index: Callable[[DataFrame], ListIndex] | None = None,
    seed: int = 42,
) -> Comparison:
    """Draws `per_class` articles of each class from `test` (all of a class that
    has fewer), predicts them with
    the baseline fitted on `train`, and verifies them against the articles of
    `train`. All news are (doc_id, title, text, label)."""
    sample = class_sample(test, per_class, "doc_id", seed).drop("draw")
    sample = materialize(shuffle_rows(sample, "doc_id", seed), "sample")
    run = run_baseline(train, sample, vectors, dim, lexicon)
    text = compose_document(F.col("title"), F.col("text"))
    known = train.select(F.col("doc_id").alias("vec_id"), "label", text.alias("content"))
    corpus = materialize(embed(known, encoder), "corpus")
    articles = sample.select(F.col("doc_id").alias("query_id"), text.alias("news"))
    queries = embed(articles, encoder, column="news")
    lists = index(corpus) if index is not None else None
    verified = materialize(verify(queries, corpus, settings, scorer, index=lists), "verified")
    truth = sample.select(F.col("doc_id").alias("query_id"), "label")
    table = compare_systems(run.predictions, run.latency_mean_sec, truth, verified)
    return Comparison(run, verified, sample, table)


def compare_systems(
    baseline: DataFrame, baseline_latency: float, truth: DataFrame, verified: DataFrame
) -> DataFrame:
    """`baseline` holds (y_true, y_pred); `verified` the rows of `verify`."""
    linguistic = system_row("NC-LBFV", baseline, baseline_latency)
    retrieval = system_row("RAG", outcomes(truth, verified, "query_id"))
    return comparison_table(linguistic, retrieval, published_row(baseline))
