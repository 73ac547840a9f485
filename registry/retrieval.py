"""Similarity search, exact and by inverted lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.functions.vectors import cosine_distance
from factlake.operators import ivf, pivots, scoring, similarity
from factlake.operators.scale import materialize, scratch_path
from factlake.sources import growing_index as growing
from registry.tables import (
    KB,
    as_queries,
    distance_sql,
    kb,
    nearest_sql,
    table,
    vote_sql,
    with_,
)

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _result(df):
    return df.select("query_id", "vec_id", "distance", "rank")


NEAREST = "SELECT query_id, vec_id, distance, CAST(rank AS INTEGER) AS rank FROM "


@query(
    with_(KB) + f"SELECT a.vec_id, {distance_sql('a.embedding', 'b.embedding')} AS distance "
    "FROM kb a JOIN kb b ON b.vec_id = a.vec_id + 1"
)
def cosine_neighbours(spark, sf):
    """Distance of every vector to the next one."""
    a = kb(spark, sf).select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    d = cosine_distance(F.col("embedding"), F.col("other"))
    return a.join(b, "vec_id").select("vec_id", d.alias("distance"))


@query(
    with_(KB) + f"""SELECT c.vec_id, c.label, {distance_sql('q.embedding', 'c.embedding')} AS distance
FROM kb c, (SELECT embedding FROM kb WHERE vec_id = 0) q
ORDER BY {distance_sql('q.embedding', 'c.embedding')} ASC NULLS LAST, c.vec_id LIMIT 10"""
)
def single_search(spark, sf):
    """One article against the whole knowledge base."""
    vectors = kb(spark, sf)
    wanted = vectors.filter("vec_id = 0").select("embedding").first()[0]
    found = similarity.search(vectors.drop("source_index"), wanted, 10)
    return found.select("vec_id", "label", "distance")


@query(with_(KB, nearest_sql(3)) + NEAREST + "nearest")
def similarity_top_k(spark, sf):
    """Every vector against all others."""
    vectors = kb(spark, sf)
    return _result(similarity.similarity_join(as_queries(vectors), vectors, 3, exclude_own=True))


@query(with_(KB, nearest_sql(3)) + NEAREST + "nearest")
def similarity_top_k_cells(spark, sf):
    """The same with both sides cut into shuffled cells, as for queries too
    many to broadcast."""
    vectors = kb(spark, sf)
    return _result(
        similarity.similarity_join(
            as_queries(vectors), vectors, 3, exclude_own=True, max_matrix_bytes=200 * 64 * 8
        )
    )


@query(with_(KB, nearest_sql(3)) + NEAREST + "nearest")
def similarity_top_k_pivots(spark, sf):
    """The same, leaving out the cells that hold nothing near."""
    vectors = kb(spark, sf)
    return _result(pivots.pivot_join(as_queries(vectors), vectors, 3, exclude_own=True))


CENTROIDS = """dims AS (
  SELECT label AS list_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS x
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
centroids AS (SELECT list_id, list(x ORDER BY i) AS centre FROM dims GROUP BY 1)"""


def given_centroids(spark, sf):
    """Mean vector of each original label."""
    entries = table(spark, sf, "embeddings").select(
        F.col("label").alias("list_id"), F.posexplode("embedding").alias("i", "x")
    )
    means = entries.groupBy("list_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy("list_id").agg(
        F.transform(ordered, lambda e: e["x"]).alias("embedding")
    )


def probes_sql(table_: str, key: str, n: int, name: str) -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT {key}, list_id, row_number() OVER (PARTITION BY {key} ORDER BY d, list_id) AS place
    FROM (SELECT v.{key}, c.list_id, {distance_sql('v.embedding', 'c.centre')} AS d
          FROM {table_} v, centroids c))
  WHERE place <= {n})"""


@query(
    with_(KB, CENTROIDS, probes_sql("kb", "vec_id", 3, "probes"))
    + "SELECT vec_id AS query_id, list_id, CAST(place AS INTEGER) AS place FROM probes"
)
def ivf_probes(spark, sf):
    queries = as_queries(kb(spark, sf)).select("query_id", "embedding")
    return ivf.probe_lists(queries, given_centroids(spark, sf), 3).drop("embedding")


@query(
    with_(KB, CENTROIDS, probes_sql("kb", "vec_id", 3, "probes"))
    + "SELECT vec_id AS query_id, list_id, CAST(place AS INTEGER) AS place FROM probes"
)
def ivf_probes_many(spark, sf):
    """The same as for more centroids than may be broadcast."""
    queries = as_queries(kb(spark, sf)).select("query_id", "embedding")
    found = ivf.probe_lists(queries, given_centroids(spark, sf), 3, max_bytes=2 * 64 * 8)
    return found.select("query_id", "list_id", "place")


def ivf_sql(probes: int, k: int) -> str:
    return with_(
        KB,
        CENTROIDS,
        probes_sql("kb", "vec_id", probes, "probes"),
        probes_sql("kb", "vec_id", 1, "lists"),
        f"""found AS (
  SELECT * FROM (
    SELECT query_id, vec_id, distance, row_number() OVER (
      PARTITION BY query_id ORDER BY distance ASC NULLS LAST, vec_id) AS rank
    FROM (
      SELECT q.vec_id AS query_id, c.vec_id, {distance_sql('q.embedding', 'c.embedding')} AS distance
      FROM probes p JOIN lists l ON p.list_id = l.list_id AND p.vec_id <> l.vec_id
      JOIN kb q ON q.vec_id = p.vec_id JOIN kb c ON c.vec_id = l.vec_id))
  WHERE rank <= {k})""",
    )


def _ivf(spark, sf, probes, **options):
    vectors = kb(spark, sf)
    return ivf.ivf_search(
        as_queries(vectors), vectors, given_centroids(spark, sf), probes, 3, exclude_own=True, **options
    )


@query(ivf_sql(2, 3) + NEAREST + "found")
def ivf_top_k(spark, sf):
    return _result(_ivf(spark, sf, 2))


@query(ivf_sql(2, 3) + NEAREST + "found")
def ivf_top_k_split(spark, sf):
    """The same with pieces so small that every list is split."""
    return _result(_ivf(spark, sf, 2, max_matrix_bytes=20 * 64 * 8))


@query(
    ivf_sql(2, 3).rstrip()
    + ",\n"
    + nearest_sql(3)
    + """
SELECT count(*) AS n_exact, count(f.vec_id) AS n_found,
  round(count(f.vec_id) / count(*), 6) AS recall
FROM nearest n LEFT JOIN found f ON n.query_id = f.query_id AND n.vec_id = f.vec_id"""
)
def ivf_recall(spark, sf):
    vectors = kb(spark, sf)
    exact = similarity.similarity_join(as_queries(vectors), vectors, 3, exclude_own=True)
    return ivf.recall_at_k(_ivf(spark, sf, 2), exact).withColumn("recall", F.round("recall", 6))


@query(
    "SELECT vec_id, true AS in_nearest_list, CAST(20 AS BIGINT) AS n_lists, CAST(0 AS BIGINT) AS n_empty FROM embeddings"
)
def ivf_training(spark, sf):
    """Lists by k-means over all rows: is every row in the list whose stored
    centroid is nearest, and has every list a row?"""
    vectors = kb(spark, sf)
    path = scratch_path(spark, "index")
    ivf.write_index(vectors, path, ivf.train_ivf(vectors, 20, max_iter=10))
    members, index = ivf.read_index(spark, path)
    centres = index.centroids.select(F.col("list_id").alias("other"), F.col("embedding").alias("centre"))
    apart = members.join(F.broadcast(centres)).withColumn(
        "d", cosine_distance(F.col("embedding"), F.col("centre"))
    )
    nearest = apart.groupBy("vec_id", "list_id").agg(F.min(F.struct("d", "other"))["other"].alias("best"))
    sizes = members.agg(F.countDistinct("list_id").alias("_used"))
    lists = index.centroids.agg(F.count("*").alias("n_lists"))
    return (
        nearest.join(F.broadcast(sizes)).join(F.broadcast(lists))
        .select("vec_id", (F.col("best") == F.col("list_id")).alias("in_nearest_list"), "n_lists",
                (F.col("n_lists") - F.col("_used")).alias("n_empty"))
    )


ARRIVALS = 4


@query(
    with_(
        KB,
        CENTROIDS,
        probes_sql("kb", "vec_id", 2, "probes"),
        probes_sql("kb", "vec_id", 1, "lists"),
        f"""found AS (
  SELECT * FROM (
    SELECT arrival, query_id, vec_id, distance, row_number() OVER (
      PARTITION BY arrival, query_id ORDER BY distance ASC NULLS LAST, vec_id) AS rank
    FROM (
      SELECT a.arrival, q.vec_id AS query_id, c.vec_id, {distance_sql('q.embedding', 'c.embedding')} AS distance
      FROM (SELECT CAST(unnest(range({ARRIVALS})) AS INTEGER) AS arrival) a
      JOIN lists l ON l.vec_id % {ARRIVALS} <= a.arrival
      JOIN probes p ON p.list_id = l.list_id AND p.vec_id <> l.vec_id
      JOIN kb q ON q.vec_id = p.vec_id JOIN kb c ON c.vec_id = l.vec_id))
  WHERE rank <= 3)""",
    )
    + "SELECT arrival, query_id, vec_id, distance, CAST(rank AS INTEGER) AS rank FROM found"
)
def growing_index(spark, sf):
    """All vectors arrive in four parts; after each, every vector searches what
    is there."""
    vectors = kb(spark, sf)
    index = growing.GrowingIndex(spark, scratch_path(spark, "growing"))
    index.create(given_centroids(spark, sf))
    out = None
    for arrival in range(ARRIVALS):
        index.insert(vectors.filter(F.col("vec_id") % ARRIVALS == arrival), f"arrival-{arrival}")
        members, lists = index.search_with(2)
        found = ivf.ivf_search(as_queries(vectors), members, lists.centroids, 2, 3, exclude_own=True)
        found = materialize(_result(found).withColumn("arrival", F.lit(arrival)), "found")
        out = found if out is None else out.unionByName(found)
    return out


@query(
    with_(KB)
    + """SELECT vec_id, label, CAST(1 AS BIGINT) AS n_places, true AS fits, true AS known_list,
  true AS nearer_half FROM kb"""
)
def growing_index_splits(spark, sf):
    """The same with lists of at most 60 rows: every row is in one list, which
    is small enough and among those that are not retired; of two halves made by
    one split, a row is in the nearer one."""
    vectors = kb(spark, sf)
    index = growing.GrowingIndex(spark, scratch_path(spark, "growing"), max_rows=60)
    index.create(given_centroids(spark, sf).filter("list_id < 3"))
    for arrival in range(ARRIVALS):
        index.insert(vectors.filter(F.col("vec_id") % ARRIVALS == arrival), f"arrival-{arrival}")
    members = materialize(index.members(), "members")
    sizes = members.groupBy("list_id").agg((F.count("*") <= 60).alias("fits"))
    lists = index.centroids().select("list_id", F.lit(True).alias("known_list"), F.col("embedding").alias("own"))
    # halves have neighbouring numbers, the first after the given three
    other = lists.select(
        F.when(F.col("list_id") % 2 == 1, F.col("list_id") + 1).otherwise(F.col("list_id") - 1).alias("list_id"),
        F.col("own").alias("other"),
    ).filter("list_id > 2")
    placed = members.join(sizes, "list_id").join(lists, "list_id", "left").join(other, "list_id", "left")
    nearer = F.round(cosine_distance(F.col("embedding"), F.col("own")), 6) <= F.round(
        cosine_distance(F.col("embedding"), F.col("other")), 6
    )
    return placed.groupBy("vec_id", "label").agg(
        F.count("*").alias("n_places"),
        F.bool_and("fits").alias("fits"),
        F.bool_and(F.coalesce("known_list", F.lit(False))).alias("known_list"),
        F.bool_and(F.coalesce(nearer, F.lit(True))).alias("nearer_half"),
    )


@query(
    with_(KB, nearest_sql(3), f"votes AS ({vote_sql('nearest', 'query_id')})")
    + "SELECT query_id, verdict AS label, confidence FROM votes"
)
def vote_verdict(spark, sf):
    vectors = kb(spark, sf)
    found = similarity.similarity_join(as_queries(vectors), vectors, 3, exclude_own=True)
    return scoring.vote_verdict(found).select("query_id", "label", "confidence")
