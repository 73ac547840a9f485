"""Verdict parsing, metrics, latency, failures and the configuration grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.functions import prompt as pr
from factlake.functions.verdict import encode_verdict
from factlake.operators import evaluate, grid, scoring
from registry.tables import (
    GRID,
    NEWS,
    RESULTS,
    VERDICTS,
    metrics_sql,
    news,
    results,
    table,
    verdicts,
    with_,
)

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    with_(VERDICTS)
    + "SELECT doc_id, config_id, verdict, confidence, reasoning, is_valid, error FROM verdicts"
)
def parse_verdicts(spark, sf):
    return verdicts(spark, sf).select(
        "doc_id", "config_id", "verdict", "confidence", "reasoning", "is_valid", "error"
    )


@query("SELECT event_id, CASE WHEN event_type = 'fake' OR event_type = 'error' THEN 0 ELSE 1 END AS y FROM events")
def encode_verdicts(spark, sf):
    """'error' stands for 'fake'; every other text is 1."""
    label = F.regexp_replace("event_type", "^error$", "fake")
    return table(spark, sf, "events").select("event_id", encode_verdict(label).alias("y"))


def _sides(spark, sf):
    answers = verdicts(spark, sf)
    return answers.select("doc_id", "label"), answers.drop("label")


def _outcomes(spark, sf):
    return scoring.outcomes(*_sides(spark, sf))


@query(with_(VERDICTS) + "SELECT doc_id, config_id, y_true, y_pred FROM aligned")
def align_predictions(spark, sf):
    rows = scoring.align(*_sides(spark, sf))
    return rows.select("doc_id", "config_id", "y_true", "y_pred")


@query(
    with_(VERDICTS, metrics_sql("aligned", "config_id"))
    + "SELECT config_id, tp, fp, fn, tn, n_scored FROM metrics"
)
def confusion_counts(spark, sf):
    return evaluate.confusion(_outcomes(spark, sf), ["config_id"])


ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in evaluate.METRICS)


@query(
    with_(VERDICTS, metrics_sql("aligned", "config_id")) + f"SELECT config_id, n_scored, {ROUNDED} FROM metrics"
)
def metrics_by_config(spark, sf):
    out = evaluate.classification_metrics(_outcomes(spark, sf), ["config_id"])
    return evaluate.round_metrics(out.select("config_id", "n_scored", *evaluate.METRICS), 6)


@query(
    with_(VERDICTS, metrics_sql("aligned", "1 AS one", pos=1)) .replace("GROUP BY 1 AS one", "GROUP BY one")
    + f"SELECT n_scored, {ROUNDED} FROM metrics"
)
def metrics_positive_real(spark, sf):
    """Over everything, with real as the positive class."""
    out = evaluate.classification_metrics(_outcomes(spark, sf), pos_label=1)
    return evaluate.round_metrics(out.select("n_scored", *evaluate.METRICS), 6)


@query(
    with_(VERDICTS) + "SELECT config_id, round(avg(latency_sec), 6) AS latency_mean_sec, "
    "count(*) AS n_timed FROM verdicts WHERE latency_sec IS NOT NULL GROUP BY config_id"
)
def latency_by_config(spark, sf):
    return evaluate.round_metrics(evaluate.latency_summary(verdicts(spark, sf), ["config_id"]), 6)


@query(
    with_(VERDICTS)
    + """SELECT config_id, position + 1 AS rows_seen, round(mean, 6) AS latency_mean_sec FROM (
  SELECT config_id, position, avg(latency_sec) OVER w AS mean FROM verdicts
  WINDOW w AS (PARTITION BY config_id ORDER BY position
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE (position + 1) % 10 = 0 AND mean IS NOT NULL"""
)
def running_latency(spark, sf):
    out = evaluate.running_latency(verdicts(spark, sf), ["config_id"], "position")
    return evaluate.round_metrics(out, 6)


@query(
    with_(VERDICTS) + "SELECT config_id, error, count(*) AS n_failed FROM verdicts "
    "WHERE NOT is_valid GROUP BY config_id, error"
)
def failures_by_config(spark, sf):
    return evaluate.failure_summary(verdicts(spark, sf), ["config_id"])


@query(
    with_(NEWS, GRID)
    + "SELECT doc_id, config_id, embedding, chunking, top_k, temperature, thinking, chunk_type FROM news, grid"
)
def config_worklist(spark, sf):
    """Every labelled article once per configuration."""
    return grid.expand_configs(news(spark, sf).select("doc_id"))


@query(
    with_(RESULTS)
    + "SELECT g.config_id, g.embedding, g.chunking, g.top_k, g.temperature FROM grid g "
    "WHERE g.config_id NOT IN (SELECT config_id FROM results WHERE f1 >= 0.33)"
)
def pending_configs(spark, sf):
    """Configurations whose results are missing or below a bound."""
    done = results(spark, sf).filter("f1 >= 0.33")
    todo = grid.pending_configs(grid.config_grid(spark), done)
    return todo.select("config_id", "embedding", "chunking", "top_k", "temperature")


BUDGET = "(CASE g.chunk_type WHEN 'full' THEN 1024 ELSE 384 END) * (g.top_k + 1) + 1024"


@query(
    with_(GRID)
    + f"""SELECT event_id, CAST(least(cap, greatest(2048, {BUDGET})) AS INTEGER) AS num_ctx, {BUDGET} > cap AS overflow
FROM (SELECT event_id, CAST(event_id % 32 + 1 AS INTEGER) AS config_id, 2048 * (1 + user_id % 4) AS cap FROM events)
JOIN grid g USING (config_id)"""
)
def context_budget(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id",
        (F.col("event_id") % 32 + 1).cast("int").alias("config_id"),
        (2048 * (1 + F.col("user_id") % 4)).cast("int").alias("cap"),
    )
    joined = events.join(F.broadcast(grid.config_grid(spark)), "config_id")
    args = F.col("top_k"), F.col("chunk_type"), F.col("cap")
    return joined.select(
        "event_id",
        pr.context_budget(*args).alias("num_ctx"),
        pr.context_overflow(*args).alias("overflow"),
    )


@query(
    "SELECT event_id, s // 60 || 'm' || s % 60 || 's' AS elapsed "
    "FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS s FROM events)"
)
def durations(spark, sf):
    elapsed = pr.format_duration(F.col("value"))
    return table(spark, sf, "events").select("event_id", elapsed.alias("elapsed"))


@query("SELECT event_id, round(value / 7, 4) AS four, round(value / 7, 6) AS six FROM events")
def rounded_values(spark, sf):
    share = F.col("value") / 7
    values = table(spark, sf, "events").select("event_id", share.alias("four"), share.alias("six"))
    return evaluate.round_metrics(evaluate.round_metrics(values, 4, ["four"]), 6, ["six"])


def _rule(request: dict) -> str:
    if request["event_id"] % 13 == 0:
        raise ValueError("no answer")
    label = "fake" if request["value"] < 50 else "real"
    return f'{{"label": "{label}", "confidence": 0.5, "reasoning": "{request["event_type"]}"}}'


@query(
    """SELECT event_id, event_id % 13 <> 0 AS is_valid,
  CASE WHEN event_id % 13 = 0 THEN 'ValueError: no answer' END AS error,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN value < 50 THEN 'fake' ELSE 'real' END AS verdict,
  CASE WHEN event_id % 13 <> 0 THEN event_type END AS reasoning
FROM events"""
)
def score_calls(spark, sf):
    """A user's scorer called for every row; failed calls are reported."""
    events = table(spark, sf, "events").select("event_id", "value", "event_type")
    parsed = scoring.parse_scores(scoring.score(events, _rule))
    return parsed.select("event_id", "is_valid", "error", "verdict", "reasoning")
