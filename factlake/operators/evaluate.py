"""Metrics, latency and failures of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.operators.scale import running_total

METRICS = ["accuracy", "precision", "recall", "specificity", "f1"]


def confusion(
    df: DataFrame, by: Sequence[str] = (), pos_label: int = 0, also: Sequence[Column] = ()
) -> DataFrame:
    """tp, fp, fn, tn and n_scored of (y_true, y_pred), and the aggregates in
    `also`. A row whose `y_pred` is NULL failed and counts nowhere; a group
    without a scored row is left out. (Failed rows are not filtered out first:
    the filter would be pushed below the parsing and parse every row twice.)"""
    truth, pred = F.col("y_true") == pos_label, F.col("y_pred") == pos_label
    counts = df.groupBy(*by).agg(
        F.count_if(truth & pred).alias("tp"),
        F.count_if(~truth & pred).alias("fp"),
        F.count_if(truth & ~pred).alias("fn"),
        F.count_if(~truth & ~pred).alias("tn"),
        F.count("y_pred").alias("n_scored"),
        *also,
    )
    return counts.filter("n_scored > 0") if by else counts


def ratio(top: Column, bottom: Column) -> Column:
    """0 when the denominator is 0."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def specificity() -> Column:
    return ratio(F.col("tn"), F.col("tn") + F.col("fp"))


def with_metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "specificity": specificity(),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def classification_metrics(
    df: DataFrame, by: Sequence[str] = (), pos_label: int = 0, also: Sequence[Column] = ()
) -> DataFrame:
    """Counts and metrics; the positive class is fake (0) unless told."""
    return with_metrics(confusion(df, by, pos_label, also))


def mean_latency() -> Column:
    """Mean of the per-row times of the scored rows."""
    return F.avg(F.when(F.col("y_pred").isNotNull(), F.col("latency_sec")))


def round_metrics(df: DataFrame, digits: int = 4, names: Sequence[str] | None = None) -> DataFrame:
    """Rounds the metrics and the latency, or the named columns."""
    names = names or [c for c in df.columns if c in METRICS or c == "latency_mean_sec"]
    return df.withColumns({c: F.round(c, digits) for c in names})


def latency_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the per-row times of the rows that were answered."""
    return (
        df.filter("latency_sec is not null")
        .groupBy(*by)
        .agg(F.avg("latency_sec").alias("latency_mean_sec"), F.count("*").alias("n_timed"))
    )


def running_latency(
    df: DataFrame, by: Sequence[str], position: str, every: int = 10
) -> DataFrame:
    """Mean latency so far after every `every` rows of each configuration;
    failed rows count for the position but not for the mean."""
    timed = F.col("latency_sec").isNotNull()
    totals = running_total(
        df,
        by,
        position,
        {"_sum": F.col("latency_sec"), "_timed": F.when(timed, 1).otherwise(0)},
    )
    return totals.filter(((F.col(position) + 1) % every == 0) & (F.col("_timed") > 0)).select(
        *by,
        (F.col(position) + 1).alias("rows_seen"),
        (F.col("_sum") / F.col("_timed")).alias("latency_mean_sec"),
    )


def failure_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.filter("not is_valid").groupBy(*by, "error").agg(F.count("*").alias("n_failed"))


def dataset_profile(df: DataFrame) -> DataFrame:
    """Row count by class."""
    return df.groupBy("label").agg(F.count("*").alias("n_rows"))


def rederive_specificity(df: DataFrame, n_pos: int = 50, n_neg: int = 50) -> DataFrame:
    """Specificity worked back from rounded ratios, with truncated counts; kept
    beside the exact one of `with_metrics` because published tables use it."""
    tp = (F.col("recall") * n_pos).cast("int")
    tn = (F.col("accuracy") * (n_pos + n_neg) - tp).cast("int")
    return df.withColumn("specificity", tn / F.lit(n_neg))
