"""Inverted lists that grow: commits, splits, crashes, and what is written."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.functions.encoders import hashing_encoder
from factlake.operators import ivf
from factlake.operators.similarity import similarity_join
from factlake.plans import index
from factlake.schemas import NEWS
from factlake.sources import growing_index
from factlake.sources import kb as store
from factlake.sources.growing_index import GrowingIndex, variant_index

SCHEMA = "vec_id long, source_index long, label int, embedding array<float>"


def vectors(n, seed=1, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 8))
    rows = centres[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, 8))
    return [(i, i, i % 2, x.tolist()) for i, x in enumerate(rows)]


def files(path):
    found = {}
    for folder, _, names in os.walk(f"{path}/members"):
        for name in names:
            if name.endswith(".parquet"):
                at = os.path.join(folder, name)
                found[at] = (os.stat(at).st_mtime_ns, os.stat(at).st_size)
    return found


def made(spark, path, rows, lists=3, **options):
    grown = GrowingIndex(spark, str(path), **options)
    grown.create(ivf.train_ivf(spark.createDataFrame(rows, SCHEMA), lists))
    return grown


def test_commits_add_files_and_change_none(spark, tmp_path):
    rows = vectors(120)
    grown = made(spark, tmp_path, rows)
    assert grown.exists() and grown.commits() == [] and grown.members() is None
    before = {}
    for part in range(3):
        assert grown.insert(spark.createDataFrame(rows[part::3], SCHEMA), f"c{part}")
        now = files(tmp_path)
        assert {k: now[k] for k in before} == before and len(now) > len(before)
        before = now
    assert grown.commits() == ["c0", "c1", "c2"]
    # a commit that is finished is not run again
    assert not grown.insert(spark.createDataFrame(rows[:7], SCHEMA), "c1") and files(tmp_path) == before
    members = grown.members()
    assert sorted(r.vec_id for r in members.collect()) == list(range(120))
    whole = ivf.assign_lists(spark.createDataFrame(rows, SCHEMA), grown.centroids())
    assert sorted(members.select("vec_id", "list_id").collect()) == sorted(whole.select("vec_id", "list_id").collect())
    some = spark.createDataFrame([(1,)], "list_id int")
    assert {r.list_id for r in grown.members(some).collect()} == {1}
    plan = grown.members(some)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list_id", plan)


def test_large_lists_are_split_and_no_other_is_written(spark, tmp_path):
    rows = vectors(60)
    grown = made(spark, tmp_path, rows, max_rows=40)
    grown.insert(spark.createDataFrame(rows, SCHEMA), "c0")
    before = files(tmp_path)
    # one direction gets all that is new
    more = [(1000 + i, 1000 + i, 0, (np.array(rows[0][3]) + 0.01 * i).tolist()) for i in range(150)]
    grown.insert(spark.createDataFrame(more, SCHEMA), "c1")
    now = files(tmp_path)
    assert {k: now[k] for k in before} == before
    live = grown.live().groupBy("list_id").agg(F.sum("n_rows").alias("n")).collect()
    assert max(r.n for r in live) <= 40 and sum(r.n for r in live) == 210
    assert sorted(r.vec_id for r in grown.members().collect()) == sorted([r[0] for r in rows + more])
    retired = {r.list_id for r in grown.log().filter("retired").collect()}
    alive = {r.list_id for r in grown.centroids().collect()}
    assert retired and not retired & alive and {r.list_id for r in live} <= alive
    # searches still find most of what is nearest
    asked = spark.createDataFrame(rows + more, SCHEMA).withColumnRenamed("vec_id", "query_id")
    members, lists = grown.search_with(probes=4)
    found = ivf.ivf_search(asked, members, lists.centroids, lists.probes, 5)
    exact = similarity_join(asked, members.drop("list_id"), 5)
    assert ivf.recall_at_k(found, exact).first()["recall"] >= 0.9


def test_copies_and_vectors_without_direction_are_dealt(spark, tmp_path):
    rows = [(i, i, 0, [1.0, 1.0]) for i in range(70)] + [(100 + i, i, 0, [0.0, 0.0]) for i in range(30)]
    grown = made(spark, tmp_path, rows[:1], lists=1, max_rows=16)
    grown.insert(spark.createDataFrame(rows, SCHEMA), "c0")
    sizes = [r.n for r in grown.live().groupBy("list_id").agg(F.sum("n_rows").alias("n")).collect()]
    assert max(sizes) <= 16 and sum(sizes) == 100
    assert grown.members().count() == 100


def test_unfinished_commit_counts_for_nothing(spark, tmp_path, monkeypatch):
    rows = vectors(90)
    grown = made(spark, tmp_path, rows, max_rows=20)
    grown.insert(spark.createDataFrame(rows[:40], SCHEMA), "c0")
    held = sorted(r.vec_id for r in grown.members().collect())

    def stopped(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(GrowingIndex, "_commit", stopped)
    with pytest.raises(RuntimeError):
        grown.insert(spark.createDataFrame(rows[40:], SCHEMA), "c1")
    monkeypatch.undo()
    assert sorted(r.vec_id for r in grown.members().collect()) == held and grown.commits() == ["c0"]
    grown.insert(spark.createDataFrame(rows[40:], SCHEMA), "c1")
    assert sorted(r.vec_id for r in grown.members().collect()) == list(range(90))


def test_no_rows_and_no_lists(spark, tmp_path):
    rows = vectors(5)
    grown = made(spark, tmp_path / "a", rows, lists=2)
    assert grown.insert(spark.createDataFrame([], SCHEMA), "c0") and grown.members() is None
    members, lists = grown.search_with()
    assert members.count() == 0 and lists.centroids.count() == 2
    with pytest.raises(ValueError):
        GrowingIndex(spark, str(tmp_path / "b")).insert(spark.createDataFrame(rows, SCHEMA), "c0")


def test_killed_between_batch_and_index(spark, tmp_path, monkeypatch):
    """The next run indexes what the killed one had only written."""
    rng = random.Random(1)
    data = [(i, "t", " ".join(f"w{rng.randint(0, 50)}" for _ in range(300)), 1, "train") for i in range(12)]
    news = spark.createDataFrame(data, NEWS)
    path, root = str(tmp_path / "kb"), str(tmp_path / "lists")
    encoders = {"EMB-A": hashing_encoder(0)}

    def stopped(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(index, "insert_batch", stopped)
    with pytest.raises(RuntimeError):
        index.build_kb(news, path, encoders, rows_per_commit=6, index_root=root, lists=2)
    monkeypatch.undo()
    assert index.build_kb(news, path, encoders, rows_per_commit=6, index_root=root, lists=2) == 1
    for model, chunking in index.variants_of(encoders):
        grown = variant_index(spark, root, model, chunking)
        stored = store.with_vec_id(store.read_kb(spark, path, model, chunking))
        assert sorted(r.vec_id for r in grown.members().collect()) == sorted(r.vec_id for r in stored.collect())
        assert len(grown.commits()) == 2 and growing_index.MAX_LIST_ROWS == 1_000_000


def test_many_small_lists_share_folders_and_one_step(spark, tmp_path):
    """Hundreds of splits are one step of tasks, not one step for each level,
    and small lists do not have a folder each."""
    rows = vectors(3000)
    grown = made(spark, tmp_path, rows, max_rows=20)
    grown.insert(spark.createDataFrame(rows, SCHEMA), "c0")
    sizes = [r.n for r in grown.live().groupBy("list_id").agg(F.sum("n_rows").alias("n")).collect()]
    assert len(sizes) > 150 and max(sizes) <= 20 and sum(sizes) == 3000
    folders = os.listdir(tmp_path / "members")
    assert sorted(folders) == ["folder=c0", "folder=c0-1"]
    assert len([f for f in os.listdir(tmp_path / "members" / "folder=c0-1") if "=" in f]) < len(sizes) / 10
    assert sorted(r.vec_id for r in grown.members().collect()) == list(range(3000))
    centres = {r.list_id: np.array(r.embedding) for r in grown.centroids().collect()}
    assert len(centres) == len(sizes)
    unit = {i: c / np.sqrt(c @ c) for i, c in centres.items()}
    for r in grown.members().collect():
        other = r.list_id + 1 if r.list_id % 2 else r.list_id - 1  # the first three were given
        if other in unit:
            assert unit[r.list_id] @ np.array(r.embedding) >= unit[other] @ np.array(r.embedding) - 1e-6


@pytest.mark.parametrize("in_task", [16 << 20, 8 * 8 * 500])
def test_lists_too_large_for_a_task_are_halved_first(spark, tmp_path, monkeypatch, in_task):
    monkeypatch.setattr(growing_index, "MAX_TASK_BYTES", in_task)
    rows = vectors(2000, seed=4)
    grown = made(spark, tmp_path, rows, lists=2, max_rows=50)
    grown.insert(spark.createDataFrame(rows, SCHEMA), "c0")
    sizes = [r.n for r in grown.live().groupBy("list_id").agg(F.sum("n_rows").alias("n")).collect()]
    assert max(sizes) <= 50 and sum(sizes) == 2000
    assert sorted(r.vec_id for r in grown.members().collect()) == list(range(2000))
