"""Inverted lists that grow with the knowledge base.

Layout below one folder: `members/folder=f/list_ids=g` holds the rows of 64
neighbouring lists, sorted by list, `lists/commit=c` the centroids of the lists
that a commit has made, and `log/commit=c` what the commit did: which folder got
how many rows of which list, and which lists are retired. A commit counts once its log entry is finished; it is written last, so
a job that dies half-way changes nothing, and its commit can be run again.

New rows go to their nearest list and into files of their own: files that stand
are never written again. A list above `max_rows` is retired, and its rows move
to two new lists by two-means over this list alone, again and again until every
list fits. A list that fits a task is cut down there, level by level, and only
the lists that remain are numbered and written; a larger one is halved by all
tasks together. Which lists and files are alive follows from the log in any
order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.functions.vectors import norm
from factlake.operators.grid import CHUNK_TYPE
from factlake.operators.ivf import CENTROIDS, LISTS, ListIndex, assign_lists, train_ivf
from factlake.operators.scale import materialize
from factlake.operators.similarity import unit_matrix
from factlake.sources.files import committed_folders, is_committed
from factlake.sources.kb import read_batch, with_vec_id

MAX_LIST_ROWS = 1_000_000
ROUNDS = 8
# A list whose vectors stay below this is split to the end in one task.
MAX_TASK_BYTES = 16 << 20
# Lists of one folder, so that many small lists do not become as many files.
LISTS_PER_FOLDER = 64
# More lists than this are looked up in a table, not in an expression.
MAX_NAMED_LISTS = 1000
CREATED = "created"
LOG = "list_id int, folder string, n_rows bigint, retired boolean"


@dataclass(frozen=True)
class GrowingIndex:
    """The index of one model and chunking, stored at `path`."""

    spark: SparkSession
    path: str
    max_rows: int = MAX_LIST_ROWS

    def create(self, centroids: DataFrame) -> None:
        """Empty lists around the centroids, as the first commit."""
        self._commit(CREATED, centroids, self.spark.createDataFrame([], LOG))

    def exists(self) -> bool:
        return is_committed(self.spark, f"{self.path}/log/commit={CREATED}")

    def commits(self) -> list[str]:
        """Names of the finished inserts."""
        found = committed_folders(self.spark, f"{self.path}/log", "commit")
        return [c for c in found if c != CREATED]

    def log(self) -> DataFrame:
        """All entries of the finished commits."""
        found = committed_folders(self.spark, f"{self.path}/log", "commit")
        if not found:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*found.values())

    def live(self) -> DataFrame:
        """list_id, folder and n_rows of what is to be read."""
        log = self.log()
        retired = log.filter("retired").select("list_id")
        return log.filter("not retired").join(retired, "list_id", "left_anti").drop("retired")

    def centroids(self) -> DataFrame:
        """The lists that are not retired."""
        found = committed_folders(self.spark, f"{self.path}/log", "commit")
        tables = [f"{self.path}/lists/commit={c}" for c in found]
        lists = self.spark.read.schema(CENTROIDS).parquet(*tables)
        retired = self.log().filter("retired").select("list_id")
        return lists.join(retired, "list_id", "left_anti")

    def members(self, lists: DataFrame | None = None) -> DataFrame | None:
        """The stored rows with their list_id, of all lists or of the given
        ones (list_id); None without any. Files of other lists are not read."""
        live = self.live() if lists is None else self.live().join(lists, "list_id", "left_semi")
        return self._rows_of(live)

    def search_with(self, probes: int = 10) -> tuple[DataFrame, ListIndex]:
        """The stored rows, and the index that their searches take."""
        members = self.members()
        if members is None:
            none = "vec_id bigint, source_index bigint, label int, embedding array<float>, list_id int"
            members = self.spark.createDataFrame([], none)
        return members, ListIndex(materialize(self.centroids(), "centroids"), probes)

    def insert(self, rows: DataFrame, commit: str) -> bool:
        """Adds rows (vec_id, embedding and others) as one commit; one that is
        finished is left as it is (False)."""
        if is_committed(self.spark, f"{self.path}/log/commit={commit}"):
            return False
        lists = materialize(self.centroids(), "centroids")
        if lists.isEmpty():
            raise ValueError("an index needs a list: create it with centroids")
        log = self._store(assign_lists(rows, lists), commit)
        made = self.spark.createDataFrame([], CENTROIDS)
        in_task = max(1, MAX_TASK_BYTES // (8 * len(lists.first()["embedding"])))
        step = 0
        while True:
            live = self.live().unionByName(log.filter("not retired").drop("retired"))
            gone = log.filter("retired").select("list_id")
            live = live.join(gone, "list_id", "left_anti")
            sizes = live.groupBy("list_id").agg(F.sum("n_rows").alias("n"))
            large = materialize(sizes.filter(F.col("n") > self.max_rows), "large-lists")
            if large.isEmpty():
                break
            huge = large.filter(F.col("n") > in_task)
            whole = huge.isEmpty()
            large = (large if whole else huge).select("list_id")
            everything = lists.unionByName(made)
            moved = self._rows_of(live.join(large, "list_id", "left_semi"))
            next_id = everything.agg(F.max("list_id")).first()[0] + 1
            if whole:
                halves, moved = split_in_tasks(moved, self.max_rows, next_id)
            else:
                halves, moved = split_lists(moved, everything.join(large, "list_id"), next_id)
            made = materialize(made.unionByName(halves), "made-lists")
            step += 1
            stored = self._store(moved, f"{commit}-{step}")
            retired = large.selectExpr("list_id", "CAST(NULL AS STRING) AS folder", "0L AS n_rows", "true AS retired")
            log = materialize(log.unionByName(stored).unionByName(retired), "log")
        self._commit(commit, made, log)
        return True

    def _rows_of(self, live: DataFrame) -> DataFrame | None:
        """Rows of the lists and folders given; the filters prune folders, and
        parts of their files."""
        out = None
        for row in sorted(live.groupBy("folder").agg(F.collect_set("list_id").alias("ids")).collect()):
            stored = self.spark.read.parquet(f"{self.path}/members/folder={row.folder}")
            part = stored.filter(F.col("list_ids").isin(sorted({i // LISTS_PER_FOLDER for i in row.ids})))
            part = part.drop("list_ids")
            if len(row.ids) <= MAX_NAMED_LISTS:
                part = part.filter(F.col("list_id").isin(row.ids))
            else:
                named = self.spark.createDataFrame([(i,) for i in row.ids], "list_id int")
                part = part.join(F.broadcast(named), "list_id", "left_semi")
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def _store(self, rows: DataFrame, folder: str) -> DataFrame:
        """Writes rows into a new folder, a hot list by many tasks; returns its
        entries in the log."""
        path = f"{self.path}/members/folder={folder}"
        ranged = rows.withColumn("list_ids", F.floor(F.col("list_id") / LISTS_PER_FOLDER).cast("int"))
        ranged = ranged.repartitionByRange("list_id", "vec_id").sortWithinPartitions("list_ids", "list_id")
        ranged.write.mode("overwrite").partitionBy("list_ids").parquet(path)
        if rows.sparkSession.read.schema("vec_id bigint, list_id int").parquet(path).isEmpty():
            return self.spark.createDataFrame([], LOG)
        counts = self.spark.read.parquet(path).groupBy("list_id").agg(F.count("*").alias("n_rows"))
        named = counts.select("list_id", F.lit(folder).alias("folder"), "n_rows", F.lit(False).alias("retired"))
        return materialize(named, "log")

    def _commit(self, commit: str, lists: DataFrame, log: DataFrame) -> None:
        lists.select(*CENTROIDS.names).write.mode("overwrite").parquet(f"{self.path}/lists/commit={commit}")
        log.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/commit={commit}")


def split_lists(rows: DataFrame, lists: DataFrame, next_id: int) -> tuple[DataFrame, DataFrame]:
    """Two new lists for each of `lists` (list_id, embedding), and their rows
    with the new list_id. Two-means by cosine, all lists at once: tasks add up
    their rows by half, and only sums per half are shuffled. The first halves
    are set apart from the old centroid by its distance to a far row. Rows of
    no direction, and all rows of a list that has one direction only, are dealt
    by a hash of their id, as no half is nearer."""
    dim = len(lists.first()["embedding"])
    places = {r.list_id: i for i, r in enumerate(lists.select("list_id").orderBy("list_id").collect())}
    centres = np.zeros((len(places), 2, dim))
    for r in lists.collect():
        centres[places[r.list_id], 0] = r.embedding
    units = rows.select("list_id", "vec_id", "embedding").filter(norm(F.col("embedding").cast("array<double>")) > 0)
    # the row farthest from the old centroid, ties to the smallest id
    shared = rows.sparkSession.sparkContext.broadcast((places, centres[:, 0]))

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, centres = shared.value
        for b in batches:
            at = np.array([places[i] for i in b.column("list_id").to_pylist()], np.int64)
            x = unit_matrix(b.column("embedding"), centres.shape[1])
            similar = np.round(np.einsum("ij,ij->i", x, centres[at]), 9)
            columns = [b.column("list_id"), b.column("vec_id"), pa.array(similar), b.column("embedding")]
            yield pa.RecordBatch.from_arrays(columns, names=["list_id", "vec_id", "similar", "embedding"])

    kind = dict(rows.dtypes)["embedding"]
    apart = units.mapInArrow(farthest, f"list_id int, vec_id bigint, similar double, embedding {kind}")
    far = apart.groupBy("list_id").agg(F.min(F.struct("similar", "vec_id", "embedding"))["embedding"].alias("x"))
    for r in far.collect():
        x = np.array(r.x, float)
        centres[places[r.list_id], 1] = x / np.sqrt(x @ x)
    for _ in range(ROUNDS):
        now = rows.sparkSession.sparkContext.broadcast((places, _unit(centres)))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places, centres = now.value
            total, count = np.zeros_like(centres), np.zeros(centres.shape[:2], np.int64)
            for b in batches:
                at = np.array([places[i] for i in b.column("list_id").to_pylist()], np.int64)
                x = unit_matrix(b.column("embedding"), centres.shape[2])
                half = _nearer(x, centres[at])
                np.add.at(total, (at, half), x)
                np.add.at(count, (at, half), 1)
            for at, half in zip(*np.nonzero(count)):
                columns = [np.full(dim, at), np.full(dim, half), np.arange(dim), total[at, half], np.full(dim, count[at, half])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["at", "half", "i", "x", "n"])

        found = units.mapInArrow(sums, "at bigint, half bigint, i bigint, x double, n bigint")
        means = found.groupBy("at", "half", "i").agg((F.sum("x") / F.sum("n")).alias("x")).collect()
        moved = centres.copy()
        for r in means:
            moved[r.at, r.half, r.i] = r.x
        if np.allclose(moved, centres, atol=1e-9):
            break
        centres = moved
    final = rows.sparkSession.sparkContext.broadcast((places, _unit(centres)))

    @F.arrow_udf("int")
    def half_of(list_id: pa.Array, vec_id: pa.Array, embedding: pa.Array) -> pa.Array:
        places, centres = final.value
        at = np.array([places[i] for i in list_id.to_pylist()], np.int64)
        x = unit_matrix(embedding, centres.shape[2])
        alike = np.isnan(x).any(1) | (((centres[at, 0] - centres[at, 1]) ** 2).sum(1) < 1e-18)
        ids = np.asarray(vec_id, np.int64).astype(np.uint64)
        ids = (ids ^ (np.asarray(list_id).astype(np.uint64) << np.uint64(40))) * np.uint64(0x9E3779B97F4A7C15)
        dealt = ((ids ^ (ids >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) & np.uint64(1)
        half = np.where(alike, dealt.astype(np.int64), _nearer(x, centres[at]))
        return pa.array((next_id + 2 * at + half).astype(np.int32))

    made = [(next_id + 2 * at + half, centres[at, half].tolist()) for at in places.values() for half in (0, 1)]
    renamed = rows.withColumn("list_id", half_of("list_id", "vec_id", "embedding"))
    return rows.sparkSession.createDataFrame(made, CENTROIDS), renamed


def split_in_tasks(rows: DataFrame, max_rows: int, next_id: int) -> tuple[DataFrame, DataFrame]:
    """The lists that remain of each list of `rows` once none has more than
    `max_rows`, and the rows with their new list_id. Every list is one group,
    so it has to fit a task."""
    kind = T.StructType([*rows.schema, T.StructField("_leaf", T.LongType()), T.StructField("_centre", T.ArrayType(T.DoubleType()))])

    def split(table: pa.Table) -> pa.Table:
        dim = len(next((v for v in table["embedding"].to_pylist() if v is not None), []))
        leaf, centres = bisect(unit_matrix(table["embedding"], dim), _int64(table["vec_id"]), max_rows)
        first = {n: at for at, n in reversed(list(enumerate(leaf.tolist())))}
        shown = [centres[n].tolist() if first[n] == at else None for at, n in enumerate(leaf.tolist())]
        table = table.append_column("_leaf", pa.array(leaf))
        return table.append_column("_centre", pa.array(shown, pa.list_(pa.float64())))

    placed = materialize(rows.groupBy("list_id").applyInArrow(split, kind), "split-lists")
    # one row per list: as many as there are centroids
    ends = placed.groupBy("list_id").agg(F.max("_leaf").alias("n")).orderBy("list_id").collect()
    starts = np.cumsum([next_id, *(2 * (r.n // 2 + 1) for r in ends)])
    shift = rows.sparkSession.createDataFrame(
        [(r.list_id, int(at)) for r, at in zip(ends, starts)], "list_id int, _start bigint"
    )
    numbered = placed.join(F.broadcast(shift), "list_id").withColumn(
        "list_id", (F.col("_start") + F.col("_leaf")).cast("int")
    )
    made = numbered.filter("_centre is not null").select("list_id", F.col("_centre").alias("embedding"))
    return made, numbered.select(*rows.columns)


def bisect(x: np.ndarray, ids: np.ndarray, max_rows: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Number of each unit row's list after two-means, repeated until no list
    has more than `max_rows`, and the centres of the lists. The halves of one
    split have the numbers 2i and 2i + 1. Rows without a direction, and all rows
    where no half is nearer, are dealt in turn by id."""
    leaf, centres = np.zeros(len(x), np.int64), {}
    open_, number = [np.argsort(ids, kind="stable")], 0
    while open_:
        at = open_.pop(0)
        half, pair = _two_means(x[at])
        for side in (0, 1):
            part = at[half == side]
            if len(part) > max_rows:
                open_.append(part)
            else:
                leaf[part], centres[number + side] = number + side, pair[side]
        number += 2
    return leaf, centres


def _two_means(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The half of every unit row, and both means. The first centres are the
    mean of all and the row farthest from it."""
    known = ~np.isnan(x).any(1)
    usable, dealt = x[known], np.arange(len(x)) & 1
    if not len(usable):
        return dealt, np.zeros((2, x.shape[1]))
    mean = usable.mean(0)
    pair = np.stack([mean, usable[np.round(usable @ mean, 9).argmin()]])
    for _ in range(ROUNDS):
        half = _nearer_of(usable, pair)
        moved = np.stack([usable[half == s].mean(0) if (half == s).any() else pair[s] for s in (0, 1)])
        if np.allclose(moved, pair, atol=1e-9):
            break
        pair = moved
    half = _nearer_of(usable, pair)
    unit = _unit(pair)
    if half.min() == half.max() or ((unit[0] - unit[1]) ** 2).sum() < 1e-18:
        return dealt, np.stack([mean, mean])
    dealt[known] = half
    return dealt, pair


def _nearer_of(x: np.ndarray, pair: np.ndarray) -> np.ndarray:
    unit = _unit(pair)
    return (x @ unit[1] > x @ unit[0]).astype(np.int64)


def _int64(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column, dtype=np.int64)


def _unit(centres: np.ndarray) -> np.ndarray:
    length = np.sqrt((centres**2).sum(-1, keepdims=True))
    return centres / np.where(length > 0, length, 1.0)


def _nearer(x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """0 or 1: which of its two centres is nearer to each row."""
    similar = np.einsum("ij,ikj->ik", x, pairs)
    return (similar[:, 1] > similar[:, 0]).astype(np.int64)


def insert_batch(
    kb: DataFrame, root: str, commit: str, lists: int | None = None, max_rows: int = MAX_LIST_ROWS
) -> None:
    """Adds the rows of one batch (with vec_id) to the index of each of its
    models and chunkings, `root`/model/chunking. The first batch of a variant
    trains its lists: `lists`, or as many as its kind of chunk has by default."""
    for v in sorted(kb.select("embedding_model", "chunking").distinct().collect()):
        own = kb.filter((F.col("embedding_model") == v.embedding_model) & (F.col("chunking") == v.chunking))
        index = variant_index(kb.sparkSession, root, v.embedding_model, v.chunking, max_rows)
        if not index.exists():
            index.create(train_ivf(own, lists or LISTS[CHUNK_TYPE[v.chunking]]))
        index.insert(own.drop("embedding_model", "chunking"), commit)


def variant_index(
    spark: SparkSession, root: str, model: str, chunking: str, max_rows: int = MAX_LIST_ROWS
) -> GrowingIndex:
    return GrowingIndex(spark, f"{root}/{model}/{chunking}", max_rows)


def catch_up(spark: SparkSession, path: str, root: str, variants: Sequence[tuple[str, str]], **options) -> None:
    """Adds the finished batches of the knowledge base at `path` that some
    variant's index has not got, as after a job that died between the two."""
    have = [set(variant_index(spark, root, m, c).commits()) for m, c in variants]
    known = set.intersection(*have) if have else set()
    for batch in committed_folders(spark, path, "batch"):
        if batch not in known:
            insert_batch(with_vec_id(read_batch(spark, path, batch)), root, batch, **options)
