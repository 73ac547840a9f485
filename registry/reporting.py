"""Report tables over the results of all verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.operators import evaluate, report
from factlake.operators.scale import materialize, scratch_path
from factlake.plans import reports
from factlake.plans.compare import published_row, system_row
from factlake.sources import tables as tb
from registry.evaluation import _outcomes
from registry.tables import RESULTS, metrics_sql, results, with_

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


R = with_(RESULTS)
SHORT = "config_id, embedding, chunking, top_k, f1, latency_mean_sec"
COLUMNS = SHORT.split(", ")
MEAN_COLUMNS = report.MEANS
MEANS = ", ".join(f"avg({c}) AS {c}" for c in MEAN_COLUMNS)
# A mean of 4-digit values over 8 or 16 rows has at most 8 digits.
ROUNDED = ", ".join(f"round({c}, 8) AS {c}" for c in MEAN_COLUMNS)


@query(R + "SELECT * FROM results")
def results_scan(spark, sf):
    """Results appended as CSV in two parts and read back with their types."""
    path = scratch_path(spark, "results")
    rows = results(spark, sf)
    tb.append_results(rows.filter("config_id <= 16"), path, with_specificity=True)
    tb.append_results(rows.filter("config_id > 16"), path, with_specificity=True)
    return tb.read_results(spark, path, with_specificity=True)


@query(R + "SELECT * FROM results WHERE f1 IS NOT NULL AND f1 >= 0.33")
def scored_results(spark, sf):
    """Low scores are made NULL first, then dropped."""
    rows = results(spark, sf).withColumn("f1", F.when(F.col("f1") >= 0.33, F.col("f1")))
    return report.drop_unscored(rows)


@query(
    R + "SELECT config_id, embedding AS emb_id, CASE embedding WHEN 'EMB-A' THEN 'mxbai-embed-large' "
    "ELSE 'nomic-embed-text' END AS embedding, top_k AS k, temperature AS \"T\", f1 FROM results"
)
def model_names(spark, sf):
    return report.with_model_name(results(spark, sf)).select(
        "config_id", "emb_id", "embedding", "k", "T", "f1"
    )


@query(
    R + "SELECT * EXCLUDE (specificity), (trunc(accuracy * 100 - trunc(recall * 50)) / 50) AS specificity FROM results"
)
def specificity_rederived(spark, sf):
    rows = results(spark, sf).drop("specificity")
    return report.with_specificity_layout(evaluate.rederive_specificity(rows))


@query(
    R + f"""SELECT {SHORT}, CASE WHEN config_id = 17 THEN 'best' WHEN config_id = 2 THEN 'principal'
  WHEN config_id IN (4, 8, 20, 24) THEN 'context-error' ELSE embedding || '/' || chunking END AS category
FROM results"""
)
def config_categories(spark, sf):
    return report.categorise_config(results(spark, sf).select(*COLUMNS))


@query(R + f"SELECT {SHORT} FROM results WHERE latency_mean_sec BETWEEN 0 AND 110 AND f1 >= 0.35")
def preferred_zone(spark, sf):
    return report.preferred_zone(results(spark, sf), 0.35).select(*COLUMNS)


@query(R + f"SELECT {SHORT} FROM results WHERE config_id IN (2, 17)")
def highlighted_configs(spark, sf):
    return report.pick_configs(results(spark, sf)).select(*COLUMNS)


@query(
    R + "SELECT config_id, CASE chunking WHEN 'CHUNK-A' THEN 'o' ELSE 's' END AS marker, "
    "CASE top_k WHEN 1 THEN 60 WHEN 3 THEN 100 WHEN 5 THEN 140 WHEN 10 THEN 200 END AS marker_size FROM results"
)
def config_styles(spark, sf):
    return report.style_columns(results(spark, sf)).select("config_id", "marker", "marker_size")


@query(R + f"SELECT top_k, {ROUNDED} FROM (SELECT top_k, {MEANS} FROM results GROUP BY top_k)")
def summary_by_k(spark, sf):
    """Written as one CSV file and read back."""
    path = scratch_path(spark, "summary")
    summary = report.summary_by(results(spark, sf), "top_k", digits=8)
    tb.write_summary(summary, path)
    return spark.read.schema(summary.schema).option("header", True).csv(path)


@query(
    R + f"""SELECT CASE WHEN grouping(embedding) = 0 THEN 'embedding' WHEN grouping(chunking) = 0 THEN 'chunking'
    WHEN grouping(top_k) = 0 THEN 'top_k' ELSE 'temperature' END AS hyperparameter,
  CASE WHEN grouping(embedding) = 0 THEN embedding WHEN grouping(chunking) = 0 THEN chunking
    WHEN grouping(top_k) = 0 THEN CAST(top_k AS VARCHAR) ELSE CAST(temperature AS VARCHAR) END AS value,
  {', '.join(f'round(avg({c}), 8) AS {c}' for c in MEAN_COLUMNS)}
FROM results GROUP BY GROUPING SETS ((embedding), (chunking), (top_k), (temperature))"""
)
def summary_all(spark, sf):
    return report.summary_all(results(spark, sf), digits=8)


GROUPS = """SELECT embedding, chunking, top_k, round(avg(f1), 6) AS f1,
  string_agg(config_id, ',' ORDER BY config_id) AS config_ids,
  bool_or(config_id IN (4, 8, 20, 24)) AS has_error
FROM results GROUP BY embedding, chunking, top_k"""


@query(R + GROUPS)
def f1_by_group(spark, sf):
    groups = report.flag_context_errors(report.f1_by_group(results(spark, sf)))
    return report.sort_results(groups, "top_k").select(
        "embedding",
        "chunking",
        "top_k",
        F.round("f1", 6).alias("f1"),
        F.array_join(F.transform("config_ids", lambda c: c.cast("string")), ",").alias("config_ids"),
        "has_error",
    )


@query(R + "SELECT top_k, round(avg(f1), 6) AS f1 FROM results GROUP BY top_k ORDER BY 2 DESC, 1 LIMIT 1")
def best_k(spark, sf):
    return report.best_k(results(spark, sf)).select("top_k", F.round("f1", 6).alias("f1"))


@query(R + "SELECT * FROM results ORDER BY config_id")
def sorted_results(spark, sf):
    return report.sort_results(results(spark, sf))


def _report_sql(name: str, source: str) -> str:
    return f"SELECT '{name}' AS report, count(*) AS n_rows, round(sum(f1), 6) AS f1 FROM {source}"


@query(
    R
    + " UNION ALL ".join(
        [
            _report_sql("specificity", "results"),
            _report_sql("summary", """(SELECT round(avg(f1), 8) AS f1 FROM results
  GROUP BY GROUPING SETS ((embedding), (chunking), (top_k), (temperature)))"""),
            _report_sql("groups", f"({GROUPS})"),
            _report_sql("best_k", "(SELECT avg(f1) AS f1 FROM results GROUP BY top_k ORDER BY 1 DESC, top_k LIMIT 1)"),
            _report_sql("categories", "results"),
            _report_sql("preferred", f"results WHERE latency_mean_sec BETWEEN 0 AND 110 AND f1 >= {report.ZONE_F1}"),
        ]
    )
)
def report_tables(spark, sf):
    """All report tables of one run: their rows and their sums of F1."""
    rows = materialize(results(spark, sf), "results")
    parts = [
        df.agg(F.count("*").alias("n_rows"), F.round(F.sum("f1"), 6).alias("f1")).withColumn("report", F.lit(name))
        for name, df in reports.report_tables(rows, digits=8).items()
    ]
    return reduce(DataFrame.unionByName, parts)


def rendered_sql(c: str) -> str:
    return rf"coalesce(regexp_replace(printf('%.6f', {c}), '(\.\d+?)0+$', '\1'), 'N/A')"


@query(
    with_(RESULTS, metrics_sql("aligned", "1 AS one", "overall")).replace(
        "GROUP BY 1 AS one", "GROUP BY one"
    )
    + f"""SELECT system, {', '.join(f"{rendered_sql(c)} AS {c}" for c in MEAN_COLUMNS)}
FROM (
  SELECT 'RAG' AS system, round(accuracy, 4) AS accuracy, round(precision, 4) AS precision,
    round(recall, 4) AS recall, round(f1, 4) AS f1,
    (SELECT round(avg(latency_sec), 4) FROM aligned) AS latency_mean_sec
  FROM overall
  UNION ALL SELECT 'Nezafat & Samet (2024)*', 0.88, 0.94, NULL, 0.87, NULL)"""
)
def comparison_rendered(spark, sf):
    """All verdicts as one system beside the published row."""
    retrieval = system_row("RAG", _outcomes(spark, sf))
    return tb.render_na(report.comparison_table(retrieval, published_row(retrieval)))
