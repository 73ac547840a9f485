"""What the physical plans of the costly queries must (not) hold."""

import pytest

import __spark_entry__ as contract

QUERIES = contract.queries()
# These run jobs of their own or only touch report tables.
COSTLY = [
    "clean_documents", "sliding_chunks", "term_split", "vocabulary", "similarity_top_k",
    "similarity_top_k_cells", "ivf_top_k", "config_worklist", "metrics_by_config", "running_latency",
    "verify_articles", "source_index", "chunk_id_ranges", "backfill_chunks", "emotion_scores",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", COSTLY)
def test_no_product_of_tables(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_columns_are_pruned(spark, sf):
    for name in ("vocabulary", "clean_documents"):
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(QUERIES[name](spark, sf))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan(QUERIES["durations"](spark, sf))


def test_filter_reaches_the_scan(spark, sf):
    assert "EqualTo(quality,0)" in plan(QUERIES["fake_news"](spark, sf))


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    assert plan(QUERIES["similarity_top_k"](spark, sf)).count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in plan(QUERIES["random_sample"](spark, sf))


def test_one_shuffle_of_terms(spark, sf):
    """Terms are counted in their row: only per-term sums cross the network."""
    text = plan(QUERIES["vocabulary"](spark, sf))
    assert text.count("Exchange hashpartitioning(term") == 1
    assert "partial_sum" in text


def test_both_systems_get_five_hundred_of_each_class(spark, sf):
    from registry.features import PER_CLASS, system_comparison
    from registry.tables import news

    held_out = news(spark, sf).filter("split <> 'train'").groupBy("label").count().collect()
    scored = system_comparison(spark, sf).groupBy("y_true").count().collect()
    assert PER_CLASS == 500
    assert {tuple(r) for r in scored} == {(r["label"], min(r["count"], 500)) for r in held_out}
