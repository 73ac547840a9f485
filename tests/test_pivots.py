"""Exact search that leaves out cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.operators import pivots
from factlake.operators.pivots import build_pivots, choose_pivots, pivot_join
from factlake.operators.scale import materialize
from factlake.operators.similarity import similarity_join

SCHEMA = "vec_id long, source_index long, label int, embedding array<float>"


def rows_of(x, first=0):
    return [(first + i, (first + i) // 2, i % 3, v.tolist()) for i, v in enumerate(x)]


def clustered(n, clusters, spread, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dim))


def same(spark, rows, k, own, **options):
    corpus = spark.createDataFrame(rows, SCHEMA).repartition(3)
    queries = corpus.withColumnRenamed("vec_id", "query_id").drop("label")
    exact = similarity_join(queries, corpus, k, own)
    found = pivot_join(queries, corpus, k, own, **options)
    assert found.columns == exact.columns
    assert sorted(found.collect(), key=str) == sorted(exact.collect(), key=str)


@pytest.mark.parametrize("spread, k, own", [(0.05, 3, True), (0.5, 1, False), (3.0, 7, True)])
def test_equals_the_plain_search(spark, spread, k, own):
    same(spark, rows_of(clustered(300, 7, spread)), k, own)


def test_small_pieces_one_cell_many_cells(spark):
    rows = rows_of(clustered(120, 4, 0.2))
    same(spark, rows, 3, True, cells=1)
    same(spark, rows, 3, True, cells=110, max_matrix_bytes=9 * 12 * 8)


def test_vectors_without_direction_ties_and_few_rows(spark):
    x = clustered(40, 3, 0.1)
    rows = rows_of(x) + rows_of(np.repeat(x[:1], 30, 0), 100) + rows_of(np.zeros((5, 12)), 300)
    rows += [(400, 400, None, None)]
    same(spark, rows, 4, True)
    same(spark, rows[:3] + rows[-3:], 5, False)
    same(spark, rows[-3:], 2, False)


def test_cells_are_left_out(spark):
    """On clustered vectors most cells are; the counter tells how many."""
    corpus = spark.createDataFrame(rows_of(clustered(600, 20, 0.05)), SCHEMA)
    queries = corpus.withColumnRenamed("vec_id", "query_id").drop("label")
    index = build_pivots(corpus, choose_pivots(corpus, 60))
    found = pivot_join(queries, corpus, 3, index=index)
    assert index.possible == 600 * 60 and index.searched < 0.25 * index.possible
    assert found.filter("rank = 1 and distance > 1e-6").isEmpty()
    # a bound never leaves out a row: angles of members lie within their cell's
    assert (index.near <= index.far + pivots.SLACK).all() and index.sizes.sum() == 600
    assert index.members.groupBy("cell").count().filter(F.col("count") < 1).isEmpty()
    with pytest.raises(ValueError):
        pivot_join(queries, corpus, 0)


def test_queries_are_not_repeated_for_every_cell(spark, monkeypatch):
    """Where nothing can be left out, a query used to be written once for each
    cell, and k rows of it for each: here 36,000 and 108,000 rows of 600."""
    corpus = spark.createDataFrame(rows_of(clustered(600, 20, 3.0, 32)), SCHEMA)
    queries = corpus.withColumnRenamed("vec_id", "query_id").drop("label")
    index = build_pivots(corpus, choose_pivots(corpus, 60))
    written = []

    def counted(df, name):
        df = materialize(df, name)
        written.append(df.count())
        return df

    monkeypatch.setattr(pivots, "materialize", counted)
    found = pivot_join(queries, corpus, 3, index=index)
    assert index.searched > 0.9 * index.possible
    assert max(written) < 16 * 3 * 600
    assert sorted(found.collect(), key=str) == sorted(similarity_join(queries, corpus, 3).collect(), key=str)


def test_groups_hold_all_cells_and_hot_cells_are_cut():
    rng = np.random.default_rng(0)
    sizes = np.array([5, 0, 900, 40, 3, 60, 0, 7])
    groups = pivots.group_cells(rng.normal(size=(8, 4)), sizes, 100)
    assert sorted(groups.order) == [0, 2, 3, 4, 5, 7]
    for cells, cuts in zip(np.split(groups.order, groups.starts[1:]), groups.cuts):
        assert sizes[cells].sum() <= 100 * cuts and (cuts == 1 or len(cells) == 1)
    marked = np.zeros((1, 8), bool)
    marked[0, 2] = True
    (pieces,) = groups.of(marked)
    assert len(pieces) == 9 and len(set(pieces)) == 9
