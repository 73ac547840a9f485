"""Audit log, results and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions.prompt import docs_json, full_prompt
from factlake.operators.evaluate import METRICS
from factlake.schemas import AUDIT, results_schema


def audit_rows(verified: DataFrame) -> DataFrame:
    """Verified articles as rows of the audit log, with the filled prompt."""
    return verified.select(
        F.col("news").alias("news_content"),
        docs_json(F.col("docs")).alias("retrieved_docs"),
        full_prompt(F.col("prompt")).alias("prompt"),
        F.col("thinking").alias("llm_reasoning"),
        F.col("verdict").alias("label"),
        F.col("confidence").cast("double").alias("confidence"),
        F.current_timestamp().alias("created_at"),
    )


def log_verifications(verified: DataFrame, path: str, mode: str = "append") -> None:
    audit_rows(verified.filter("is_valid")).write.mode(mode).parquet(path)


def read_verifications(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).parquet(path)


def append_results(df: DataFrame, path: str, with_specificity: bool = False) -> None:
    """Adds rows to a folder of CSV files that share one header."""
    names = results_schema(with_specificity).names
    df.select(*names).write.mode("append").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, with_specificity: bool = False) -> DataFrame:
    schema = results_schema(with_specificity)
    return spark.read.schema(schema).option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """One small table as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def render_na(df: DataFrame, digits: int = 6) -> DataFrame:
    """Numbers as text without needless zeros, 'N/A' where there is none."""
    names = [c for c in df.columns if c in METRICS or c == "latency_mean_sec"]

    def text(c: str) -> Column:
        fixed = F.format_string(f"%.{digits}f", F.col(c))
        short = F.regexp_replace(fixed, r"(\.\d+?)0+$", "$1")
        return F.when(F.col(c).isNull(), "N/A").otherwise(short)

    return df.withColumns({c: text(c) for c in names})
