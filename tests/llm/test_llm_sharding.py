"""Extendible hashing."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factlake.llm.sharding import assign_shards, key_hash, read_shards, write_shards
from factlake.operators.scale import scratch_path


def slow(rows, limit):
    """Splits one bucket after the other; rows are (hash, bytes)."""
    done, todo = {}, [("", rows)]
    while todo:
        name, own = todo.pop()
        if len(own) == 1 or sum(n for _, n in own) <= limit:
            done[name] = own
            continue
        halves = defaultdict(list)
        for h, n in own:
            halves[h[len(name)]].append((h, n))
        todo += [(name + bit, half) for bit, half in halves.items()]
    return done


@pytest.mark.parametrize("limit", [50, 400, 100_000])
def test_splits_equal_one_by_one(spark, limit):
    rng = random.Random(limit)
    rows = [(i, "x" * rng.choice([0, 1, 7, 30, 60]), "s", 5) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard string, _depth int").repartition(3)
    hashes = {r.doc_id: f"{r.h:031b}" for r in frame.select("doc_id", key_hash(F.col("doc_id")).alias("h")).collect()}
    expected = slow([(hashes[i], len(t)) for i, t, *_ in rows], limit)
    got = defaultdict(list)
    out = assign_shards(frame, F.octet_length("text"), limit)
    assert sorted(out.columns) == ["_depth", "depth", "doc_id", "n_bytes", "shard", "text"]
    for r in out.collect():
        assert r.depth == len(r.shard) and r._depth == 5
        got[r.shard].append((hashes[r.doc_id], r.n_bytes))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def test_hot_keys_null_keys_and_giants(spark):
    rows = [(1, "x" * 10)] * 300 + [(None, "y" * 10)] * 200 + [(i, None) for i in range(50)] + [(77, "z" * 5000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = assign_shards(frame, F.octet_length("text"), 200)
    sizes = out.groupBy("shard").agg(F.sum("n_bytes").alias("n"), F.count("*").alias("rows")).collect()
    assert sum(r.rows for r in sizes) == len(rows)
    assert all(r.n <= 200 or r.rows == 1 for r in sizes) and max(r.n for r in sizes) == 5000
    # no shard is the beginning of another
    names = sorted(r.shard for r in sizes)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


def test_empty_table_and_files(spark):
    frame = spark.createDataFrame([(i, "x" * 40, "a") for i in range(50)], "doc_id long, text string, extra string")
    assert assign_shards(frame.limit(0), F.octet_length("text"), 10).collect() == []
    assigned = assign_shards(frame, F.octet_length("text"), 200)
    path = scratch_path(spark, "shards")
    write_shards(assigned, path)
    assert spark.read.parquet(path).count() == 50
    found = spark.read.parquet(path)
    assert {"s" + r.shard for r in assigned.collect()} == {r.shard for r in found.select("shard").distinct().collect()}
    assert found.groupBy("shard").agg(F.sum(F.length("text")).alias("n")).filter("n > 200").isEmpty()
    back = read_shards(spark, path, F.octet_length("text"), 200)
    assert sorted(back.select("doc_id", "n_bytes", "depth", "shard", "extra").collect()) == sorted(
        assigned.select("doc_id", "n_bytes", "depth", "shard", "extra").collect()
    )
    with pytest.raises(ValueError):
        read_shards(spark, path, F.octet_length("text"), 100)


def test_the_copy_of_all_rows_takes_little_disk(spark):
    """Rows are written twice (a copy with their codes, the shards) and
    shuffled once; the copy is packed more tightly than the session's files."""
    import os

    rows = [(i, " ".join(f"word{i * j % 97}" for j in range(200))) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = assign_shards(frame, F.octet_length("text"), 20_000)
    copies = {os.path.dirname(f) for f in out.inputFiles() if "/shard-rows-" in f}
    assert len(copies) == 1

    def size(path):
        path = path.removeprefix("file:")
        return sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))

    plain = scratch_path(spark, "plain")
    frame.write.parquet(plain)
    assert size(copies.pop()) < 0.9 * size(plain)
    assert out.count() == 400
