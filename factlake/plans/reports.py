"""All report tables from one results table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factlake.operators.evaluate import rederive_specificity
from factlake.operators.report import (
    best_k,
    categorise_config,
    f1_by_group,
    flag_context_errors,
    preferred_zone,
    sort_results,
    summary_all,
    with_specificity_layout,
)


def report_tables(results: DataFrame, digits: int = 4) -> dict[str, DataFrame]:
    """All tables; the means of the summary have `digits` digits."""
    return {
        "specificity": sort_results(with_specificity_layout(rederive_specificity(results))),
        "summary": summary_all(results, digits),
        "groups": sort_results(flag_context_errors(f1_by_group(results)), "top_k"),
        "best_k": best_k(results),
        "categories": sort_results(categorise_config(results)),
        "preferred": sort_results(preferred_zone(results)),
    }
