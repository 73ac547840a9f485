"""Exact and inverted-file search against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factlake.operators import ivf, similarity


def brute(queries, corpus, k, own=False):
    out = []
    for q, qv in queries:
        scored = []
        for c, cv in corpus:
            if own and q == c:
                continue
            d = None
            if qv is not None and cv is not None and any(qv) and any(cv):
                a, b = np.array(qv, float), np.array(cv, float)
                d = round(1 - a @ b / np.sqrt((a @ a) * (b @ b)), 9)
            scored.append((d is None, d or 0.0, c, d))
        for rank, (_, _, c, d) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1):
            out.append((q, rank, c, None if d is None else float(d)))
    return sorted(out)


def rows(df):
    return sorted(
        (r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in df.collect()
    )


def frame(spark, data, key):
    df = spark.createDataFrame([(i, v) for i, v in data], f"{key} long, embedding array<double>")
    return df.withColumn("source_index", F.col(key))


def points(n, dim, seed, copies=0):
    """Random vectors; the last `copies` repeat the first, with a NULL and a
    zero vector among them."""
    rng = np.random.default_rng(seed)
    data = [(i, rng.standard_normal(dim).round(3).tolist()) for i in range(n)]
    for i in range(n - copies, n):
        data[i] = (i, data[0][1])
    data[3], data[5] = (3, None), (5, [0.0] * dim)
    return data


@pytest.mark.parametrize("limit", [similarity.MAX_MATRIX_BYTES, 8 * 7 * 10])
@pytest.mark.parametrize("own", [False, True])
def test_join_equals_brute_force(spark, limit, own):
    corpus, queries = points(60, 7, 1, copies=25), points(23, 7, 2)
    got = similarity.similarity_join(
        frame(spark, queries, "query_id"), frame(spark, corpus, "vec_id"), 4, own, limit
    )
    assert rows(got) == brute(queries, corpus, 4, own)


def test_more_asked_than_there_is(spark):
    corpus, queries = points(6, 3, 3), points(6, 3, 4)
    got = similarity.similarity_join(frame(spark, queries, "query_id"), frame(spark, corpus, "vec_id"), 50)
    assert rows(got) == brute(queries, corpus, 50)


def test_copies_fill_many_blocks(spark):
    """A third of the corpus is one vector: ties go to the smallest ids."""
    corpus = [(i, [1.0, 0.0] if i % 3 else [float(i), 1.0]) for i in range(5000)]
    queries = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [1.0, 1.0])]
    got = similarity.similarity_join(frame(spark, queries, "query_id"), frame(spark, corpus, "vec_id"), 5)
    assert rows(got) == brute(queries, corpus, 5)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_both_sides_from_one_table(spark, kind):
    data = points(50, 5, 13)
    kb = frame(spark, data, "vec_id").withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    whole = similarity.similarity_join(kb.withColumn("query_id", F.col("vec_id")), kb, 3, True)
    cells = similarity.similarity_join(kb.withColumn("query_id", F.col("vec_id")), kb, 3, True, 8 * 5 * 9)
    assert rows(whole) == rows(cells)
    if kind == "double":
        assert rows(cells) == brute(data, data, 3, own=True)
    centroids = ivf.train_ivf(kb, 5)
    stored = ivf.assign_lists(kb, centroids)
    found = ivf.ivf_search(stored.withColumn("query_id", F.col("vec_id")), stored, centroids, 5, 3, True, 8 * 5 * 9)
    assert rows(found) == rows(whole)


def test_search_one(spark):
    corpus = points(40, 5, 6, copies=4)
    found = similarity.search(frame(spark, corpus, "vec_id"), corpus[0][1], 6).collect()
    assert [r["vec_id"] for r in found] == [c for _, _, c, _ in brute([corpus[0]], corpus, 6)]


def test_labels_come_along(spark):
    corpus = frame(spark, points(40, 5, 6), "vec_id").withColumn(
        "label", F.when(F.col("vec_id") != 7, (F.col("vec_id") % 2).cast("int"))
    )
    got = similarity.similarity_join(frame(spark, points(9, 5, 7), "query_id"), corpus, 40)
    for r in got.collect():
        assert r["label"] == (None if r["vec_id"] == 7 else r["vec_id"] % 2)


def test_wrong_size_is_refused(spark):
    corpus = frame(spark, [(1, [1.0, 2.0]), (2, [1.0])], "vec_id").coalesce(1)
    with pytest.raises(Exception, match="must have"):
        similarity.similarity_join(frame(spark, [(1, [1.0, 2.0])], "query_id"), corpus, 1).collect()


@pytest.mark.parametrize("limit", [similarity.MAX_MATRIX_BYTES, 8 * 6 * 9])
def test_all_lists_equal_exact(spark, limit):
    corpus, queries = points(120, 6, 8, copies=40), points(31, 6, 9)
    kb, asked = frame(spark, corpus, "vec_id"), frame(spark, queries, "query_id")
    centroids = ivf.train_ivf(kb, 8)
    assert centroids.count() == 8
    got = ivf.ivf_search(asked, kb, centroids, 8, 4, max_matrix_bytes=limit)
    assert rows(got) == brute(queries, corpus, 4)


def test_recall_grows_with_probes(spark):
    corpus, queries = points(200, 6, 10), points(40, 6, 11)
    kb, asked = frame(spark, corpus, "vec_id"), frame(spark, queries, "query_id")
    centroids = ivf.train_ivf(kb, 10).cache()
    exact = similarity.similarity_join(asked, kb, 5).cache()
    recalls = []
    for probes in (1, 4, 10):
        found = ivf.ivf_search(asked, kb, centroids, probes, 5)
        recalls.append(ivf.recall_at_k(found, exact).first()["recall"])
    assert recalls[0] <= recalls[1] <= recalls[2] == 1.0
    assert recalls[1] > 0.5


def test_stored_lists_and_clamped_number(spark):
    kb = frame(spark, points(9, 4, 12), "vec_id")
    centroids = ivf.train_ivf(kb, 100)
    assert centroids.count() <= 7  # nine rows, two of them without a direction
    stored = ivf.assign_lists(kb, centroids)
    asked = frame(spark, points(9, 4, 12), "query_id")
    a = rows(ivf.ivf_search(asked, stored, centroids, 2, 3))
    assert a == rows(ivf.ivf_search(asked, kb, centroids, 2, 3))


def test_small_cells_do_not_repeat_rows_without_bound(spark):
    """Ten times the rows are shuffled ten times as often, not a hundred."""
    repeated = {}
    for n in (400, 4000):
        kb = spark.range(n).select(
            F.col("id").alias("vec_id"), F.col("id").alias("query_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding")
        )
        both = similarity.cut_whole(kb.drop("vec_id"), kb.drop("query_id"), 20)
        lists = [df.withColumn("cell", F.lit(1)) for df in (kb.drop("vec_id"), kb.drop("query_id"))]
        repeated[n] = [df.count() for df in (*both, *similarity.cut_lists(*lists, 20))]
    assert [10 * a for a in repeated[400]] == repeated[4000] and min(repeated[400]) > 400


@pytest.mark.parametrize("copies", [0, 700])
def test_best_of_many_batches_and_queries(copies):
    """Near ties below single precision, copies, and batches in any order."""
    rng = np.random.default_rng(5)
    corpus = rng.standard_normal((3000, 16)).astype(np.float32)
    corpus[100:600] = corpus[0] * (1 + 1e-7 * rng.standard_normal((500, 16)))
    corpus[2000 : 2000 + copies] = corpus[7]
    unit = corpus / np.sqrt((corpus.astype(float) ** 2).sum(1))[:, None]
    ids = rng.permutation(3000)
    asked = np.concatenate([unit[:1300], unit[2000:2050]])
    best = similarity._Best(np.arange(len(asked)), asked, None, 5)
    for at in range(0, 3000, 700):
        part = slice(at, at + 700)
        best.offer(
            pa.table({"vec_id": ids[part], "embedding": pa.array(list(corpus[part]), pa.list_(pa.float32()))})
        )
    found = best.table()
    double = similarity.unit_matrix(pa.array(list(corpus), pa.list_(pa.float32())), 16)
    distance = np.round(1 - asked @ double.T, 9)
    for q in range(len(asked)):
        order = np.lexsort((ids, distance[q]))[:5]
        assert found["vec_id"].to_pylist()[5 * q : 5 * q + 5] == ids[order].tolist()


def test_cells_are_tasks_of_their_own(spark):
    """Their rows are few bytes, but much work: they are not put together."""
    n = 4 * similarity.LEAST_ROWS
    kb = spark.range(n).select(
        F.col("id").alias("vec_id"), F.col("id").alias("query_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding")
    )
    left, right = similarity.cut_whole(kb.drop("vec_id"), kb.drop("query_id"), n)
    assert left.select(*similarity.CELL).distinct().count() == 4
    assert (left.count(), right.count()) == (n, 4 * n)
    found = similarity.best_in_cells(left, right, 1, 2)
    used = found.select(F.spark_partition_id().alias("task"), "query_id").cache()
    assert used.count() == n and used.select("task").distinct().count() > 1
    used.unpersist()


def test_pairs_that_wait_are_the_best_ones():
    """Many blocks of one batch, the nearest rows anywhere among them."""
    rng = np.random.default_rng(8)
    corpus, asked = rng.standard_normal((9001, 16)), rng.standard_normal((300, 16))
    asked = similarity.unit_matrix(pa.array(list(asked)), 16)
    best = similarity._Best(np.arange(300), asked, np.arange(300), 4)
    own = np.arange(9001)
    best.offer(pa.table({"vec_id": own[::-1], "embedding": pa.array(list(corpus)), "source_index": own}))
    distance = np.round(1 - asked @ similarity.unit_matrix(pa.array(list(corpus)), 16).T, 9)
    distance[np.arange(300), np.arange(300)] = np.inf
    order = np.stack([np.lexsort((own[::-1], row))[:4] for row in distance])
    assert best.table()["vec_id"].to_pylist() == own[::-1][order].ravel().tolist()


def test_only_queries_with_something_near_are_compared(monkeypatch):
    """Once the limits are tight, a block is compared for the few queries whose
    largest product reaches theirs; it used to be compared for all."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6 * similarity.BLOCK, 16))
    ids = np.arange(similarity.QUERIES)
    queries = similarity.unit_matrix(pa.array(list(rng.normal(size=(len(ids), 16)))), 16)
    best = similarity._Best(ids, queries, None, 3)
    compared, pairs = [], similarity._pairs
    monkeypatch.setattr(similarity, "_pairs", lambda near: compared.append(near.size) or pairs(near))
    for at in range(0, len(x), similarity.BLOCK):
        some = slice(at, at + similarity.BLOCK)
        vec = pa.array(np.arange(len(x))[some])
        best.offer(pa.table({"vec_id": vec, "embedding": pa.array(list(x[some]))}))
    assert max(compared[-3:]) < similarity.QUERIES * similarity.BLOCK
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    nearest = np.argsort(-(queries @ unit.T), axis=1, kind="stable")[:, :3]
    assert best.table()["vec_id"].to_pylist() == nearest.reshape(-1).tolist()
