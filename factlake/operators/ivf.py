"""Inverted-file search: lists by k-means, probes, exact ranking inside them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.functions.vectors import DISTANCE_DIGITS, norm
from factlake.operators.scale import materialize
from factlake.operators.sampling import sample_n
from factlake.operators.similarity import (
    BLOCK,
    MAX_MATRIX_BYTES,
    best_in_cells,
    cut_lists,
    similarity_join,
    slim,
    top_k_per_query,
    unit_matrix,
)

# Lists per kind of chunk.
LISTS = {"full": 100, "sliding": 200}
CENTROIDS = T.StructType(
    [
        T.StructField("list_id", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
    ]
)


def train_ivf(
    kb: DataFrame, lists: int, seed: int = 42, max_iter: int = 20, sample: int | None = None
) -> DataFrame:
    """Centroids (list_id, embedding) by cosine k-means over all rows, or over
    a random `sample` of so many. The number of lists is cut to the number of
    rows; zero and NULL vectors are left out."""
    usable = kb.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    usable = usable.filter(norm(F.col("embedding")) > 0)
    if sample is not None:
        usable = sample_n(usable, sample, "vec_id", seed)
    usable = materialize(usable.select("embedding"), "ivf")
    lists = min(lists, usable.limit(lists).count())
    if lists < 2:
        centres = [list(r["embedding"]) for r in usable.limit(1).collect()]
    else:
        points = usable.select(array_to_vector("embedding").alias("features"))
        means = KMeans(k=lists, distanceMeasure="cosine", seed=seed, maxIter=max_iter)
        centres = [c.tolist() for c in means.fit(points).clusterCenters()]
    made = kb.sparkSession.createDataFrame(list(enumerate(centres)), CENTROIDS)
    return materialize(made, "centroids")


def _dim(centroids: DataFrame) -> int:
    return centroids.select(F.size("embedding")).first()[0]


def list_finder(
    centroids: DataFrame, probes: int, max_bytes: int = MAX_MATRIX_BYTES
) -> Callable[[Column], Column] | None:
    """Column function: the `probes` nearest lists of a vector, nearest first.
    The centroids are broadcast; None if they have more than `max_bytes`. A
    vector without a direction (NULL or zero) gets the first lists."""
    dim = _dim(centroids)
    rows = max_bytes // (8 * dim)
    table = centroids.select("list_id", "embedding").limit(rows + 1).toArrow()
    if len(table) > rows:
        return None
    table = table.sort_by("list_id")
    shared = centroids.sparkSession.sparkContext.broadcast(
        (np.asarray(table["list_id"], dtype=np.int32), unit_matrix(table["embedding"], dim))
    )

    @F.arrow_udf("array<int>")
    def nearest(embedding: pa.Array) -> pa.Array:
        ids, centres = shared.value
        found = [np.empty((0, min(probes, len(ids))), np.int32)]
        for at in range(0, len(embedding), BLOCK):
            rows = unit_matrix(embedding.slice(at, BLOCK), centres.shape[1])
            d = np.round(1.0 - rows @ centres.T, DISTANCE_DIGITS)
            d[np.isnan(d)] = np.inf
            found.append(ids[_smallest(d, min(probes, len(ids)))])
        lists = np.concatenate(found)
        ends = np.arange(len(lists) + 1, dtype=np.int32) * lists.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(lists.ravel(), pa.int32()))

    return nearest


def _smallest(d: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest numbers of every row in order, ties by place,
    without sorting the others."""
    if n == 1:
        return d.argmin(1)[:, None]
    nth = np.partition(d, n - 1, axis=1)[:, n - 1]
    row, at = np.nonzero(d <= nth[:, None])
    order = np.lexsort((at, d[row, at], row))
    row, at = row[order], at[order]
    return at[np.arange(len(row)) - np.searchsorted(row, row) < n].reshape(len(d), n)


def _far_lists(
    df: DataFrame, key: str, centroids: DataFrame, probes: int, max_bytes: int
) -> DataFrame:
    """Every row with each of its nearest lists and their `place`, for more
    centroids than may be broadcast: a search for centroids, in cells."""
    corpus = centroids.select(F.col("list_id").alias("vec_id"), "embedding")
    asked = df.select(F.col(key).alias("query_id"), "embedding")
    found = similarity_join(asked, corpus, probes, max_matrix_bytes=max_bytes)
    found = found.select(
        F.col("query_id").alias(key), F.col("vec_id").cast("int").alias("list_id"), F.col("rank").alias("place")
    )
    return df.join(found, key)


def assign_lists(
    kb: DataFrame, centroids: DataFrame, max_bytes: int = MAX_MATRIX_BYTES
) -> DataFrame:
    """The knowledge base with the `list_id` of every row, to be stored."""
    find = list_finder(centroids, 1, max_bytes)
    if find is None:
        return _far_lists(kb, "vec_id", centroids, 1, max_bytes).drop("place")
    return kb.withColumn("list_id", find(F.col("embedding"))[0])


def probe_lists(
    queries: DataFrame, centroids: DataFrame, probes: int, max_bytes: int = MAX_MATRIX_BYTES
) -> DataFrame:
    """Every query with each of its nearest lists: `place` 1 is the nearest."""
    find = list_finder(centroids, probes, max_bytes)
    if find is None:
        return _far_lists(queries, "query_id", centroids, probes, max_bytes)
    placed = queries.select("*", F.posexplode(find(F.col("embedding"))).alias("place", "list_id"))
    return placed.withColumn("place", F.col("place") + 1)


def ivf_search(
    queries: DataFrame,
    kb: DataFrame,
    centroids: DataFrame,
    probes: int,
    k: int,
    exclude_own: bool = False,
    max_matrix_bytes: int = MAX_MATRIX_BYTES,
) -> DataFrame:
    """Top-k among the members of the `probes` lists nearest to each query. May
    return fewer than k rows. `kb` may already hold `list_id`; a list of any
    size is cut into pieces that fit a task, and so are its queries."""
    if "list_id" in kb.columns:
        members = slim(kb, "vec_id", exclude_own, "list_id")
    else:
        members = assign_lists(slim(kb, "vec_id", exclude_own), centroids)
        members = materialize(members, "members")
    members = members.withColumnRenamed("list_id", "cell")
    probed = probe_lists(slim(queries, "query_id", exclude_own), centroids, probes)
    probed = materialize(probed.drop("place").withColumnRenamed("list_id", "cell"), "probes")
    dim = _dim(centroids)
    rows = max(1, max_matrix_bytes // (8 * dim))
    return top_k_per_query(best_in_cells(*cut_lists(probed, members, rows), k, dim), k)


@dataclass(frozen=True)
class ListIndex:
    """What a search by inverted lists needs beside a knowledge base that
    stores `list_id`."""

    centroids: DataFrame
    probes: int = 10


def write_index(kb: DataFrame, path: str, centroids: DataFrame) -> None:
    """Stores the centroids and all rows of one model and chunking with their
    list, so that searches assign nothing."""
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    assign_lists(kb, centroids).write.mode("overwrite").parquet(f"{path}/members")


def read_index(spark: SparkSession, path: str, probes: int = 10) -> tuple[DataFrame, ListIndex]:
    """The stored rows, and the index that their searches take."""
    centroids = spark.read.schema(CENTROIDS).parquet(f"{path}/centroids")
    return spark.read.parquet(f"{path}/members"), ListIndex(centroids, probes)


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate search found."""
    found = approx.select("query_id", "vec_id", F.lit(1).alias("hit"))
    joined = exact.select("query_id", "vec_id").join(found, ["query_id", "vec_id"], "left")
    return joined.agg(
        F.count("*").alias("n_exact"),
        F.count("hit").alias("n_found"),
        F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"),
    )
