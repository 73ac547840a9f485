"""The building blocks, with limits so small that every split is used."""

import pytest
from pyspark.sql import functions as F

from factlake.operators import sampling, scale
from factlake.operators.evaluate import running_latency


def test_skew_join_splits_hot_keys(spark):
    left = spark.range(3000).select(
        F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k")
    )
    right = spark.range(2500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = scale.skew_join(left, right, "k", "row", rows_per_split=100)
    want = left.join(right, "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    hot = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("row"))
    assert scale.skew_join(hot, right, "k", "row", 2).select("v").distinct().count() == 1


def test_lookup_join_beyond_the_broadcast_limit(spark):
    left = spark.range(500).select(F.col("id").alias("row"), (F.col("id") % 7).alias("k"))
    right = spark.range(5).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    small = scale.lookup_join(left, right, "k", "row")
    large = scale.lookup_join(left, right, "k", "row", max_rows=2)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()


def test_running_total_over_blocks(spark):
    df = spark.range(1000).select(
        (F.col("id") % 3).alias("g"), F.floor(F.col("id") / 3).alias("p"), (F.col("id") % 11).alias("x")
    )
    got = scale.running_total(df, ["g"], "p", {"total": F.col("x")}, block=7)
    want = {}
    for i in range(1000):
        g, p = i % 3, i // 3
        want[g, p] = want.get((g, p - 1), 0) + i % 11
    assert {(r["g"], r["p"]): r["total"] for r in got.collect()} == want


def test_dense_index_of_uneven_keys(spark):
    keys = sorted({i * i * i % 100_003 for i in range(700)} | {10**15})
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "doc_id long")
    got = {r["doc_id"]: r["source_index"] for r in sampling.with_source_index(df, "doc_id").collect()}
    assert got == {k: i for i, k in enumerate(keys)}


def test_dense_index_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long")
    assert sampling.with_source_index(empty, "doc_id").count() == 0


def test_top_n_in_two_steps(spark):
    df = spark.range(2000).select("id", (F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    one = scale.top_n_per_group(df, ["g"], [F.col("h")], 5)
    two = scale.top_n_per_group(df, ["g"], [F.col("h")], 5, spread_by="id")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_shuffle_and_samples(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    shuffled = sampling.shuffle_rows(df, "doc_id", 1)
    rows = shuffled.collect()
    assert [r["position"] for r in rows] == list(range(300))
    assert [r["doc_id"] for r in rows] != sorted(r["doc_id"] for r in rows)
    assert sampling.sample_n(df, 40, "doc_id").distinct().count() == 40
    balanced = sampling.balanced_sample(df, 50, "doc_id").collect()
    assert sorted(r["label"] for r in balanced) == [0] * 50 + [1] * 50
    again = sampling.balanced_sample(df.repartition(7), 50, "doc_id").collect()
    assert [r["doc_id"] for r in again] == [r["doc_id"] for r in balanced]


def test_a_class_that_is_too_small(spark):
    df = spark.range(10).select(F.col("id").alias("doc_id"), (F.col("id") > 7).cast("int").alias("label"))
    with pytest.raises(Exception, match="fewer than 5 rows"):
        sampling.balanced_sample(df, 5, "doc_id").collect()


def test_running_latency_skips_failed_rows(spark):
    rows = [(1, p, None if p % 4 == 0 else float(p)) for p in range(25)] + [(2, p, None) for p in range(20)]
    df = spark.createDataFrame(rows, "config_id int, position long, latency_sec double")
    got = {(r["config_id"], r["rows_seen"]): r["latency_mean_sec"] for r in running_latency(df, ["config_id"], "position").collect()}
    first = [p for p in range(10) if p % 4]
    both = [p for p in range(20) if p % 4]
    assert got == {(1, 10): sum(first) / len(first), (1, 20): sum(both) / len(both)}


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    assert scale.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
