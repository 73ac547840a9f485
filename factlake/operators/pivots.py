"""Exact cosine top-k that leaves out whole cells of the corpus.

Rows belong to the nearest of some pivots; a cell knows the smallest and the
largest angle between its pivot and its rows. Angles obey the triangle
inequality, so no row of a cell is nearer to a query than the query's angle to
the pivot less the largest, or the smallest less it. Every query first searches
the cells nearest to it that hold enough rows; then only cells whose bound does
not exceed the k-th distance found there. Results are those of `similarity_join`.

Cells are many (the root of the rows), and most of them may be open to a query,
so queries are not repeated for cells. Neighbouring cells form groups that fill
a task, hot cells are cut into several; a query is sent to each group with an
open cell once, and there its open cells are found again and searched.

Vectors without a direction (NULL, zero) are at no distance. Queries that have
none, or that find fewer than k rows with a distance, are few or the corpus is
small; they are searched without cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions.vectors import norm
from factlake.operators.sampling import sample_n
from factlake.operators.scale import materialize
from factlake.operators.similarity import (
    BLOCK,
    CELLS,
    LEAST_ROWS,
    MAX_MATRIX_BYTES,
    MAX_PIECES,
    QUERIES,
    ROUNDING,
    _Best,
    _ids,
    _own,
    _Rows,
    cogrouped,
    similarity_join,
    slim,
    top_k_per_query,
    unit_matrix,
)

# Angles are off by less than this, also near 0, where a cosine says least.
SLACK = 1e-6
# Bounds of queries and cells that a task holds at a time.
BOUNDS = 4 << 20
# One row of each task has no ids, but how many cells its queries searched.
COUNTED = "query_id long, vec_id long, label int, distance double, searched long"


def _directed(df: DataFrame) -> DataFrame:
    return df.filter(norm(F.col("embedding").cast("array<double>")) > 0)


def choose_pivots(corpus: DataFrame, cells: int | None = None, seed: int = 42) -> np.ndarray:
    """Unit vectors of random rows, as many as the root of the rows by default
    and no more than may be broadcast."""
    rows = _directed(corpus.select("vec_id", "embedding"))
    first = rows.first()
    if first is None:
        return np.zeros((0, 1))
    dim = len(first["embedding"])
    cells = cells or isqrt(rows.count())
    cells = max(1, min(cells, MAX_MATRIX_BYTES // (8 * dim)))
    picked = sample_n(rows, cells, "vec_id", seed).orderBy("vec_id").select("embedding").toArrow()
    return unit_matrix(picked["embedding"], dim)


def _angles(column: pa.Array, pivots: np.ndarray):
    """Angles of a block of rows to all pivots, block by block."""
    for at in range(0, len(column), BLOCK):
        rows = unit_matrix(column.slice(at, BLOCK), pivots.shape[1])
        yield at, np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def _int_lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    values = np.concatenate(found) if found else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


@dataclass
class PivotIndex:
    """The corpus in cells (`members` has `cell`), written down once, with the
    angles and sizes of the cells, and counts of the searches' work."""

    members: DataFrame
    pivots: np.ndarray
    near: np.ndarray
    far: np.ndarray
    sizes: np.ndarray
    searched: int = 0
    possible: int = 0


def build_pivots(
    corpus: DataFrame, pivots: np.ndarray, exclude_own: bool = False
) -> PivotIndex:
    rows = _directed(slim(corpus, "vec_id", exclude_own))
    shared = corpus.sparkSession.sparkContext.broadcast(pivots)

    @F.arrow_udf("struct<cell:int,angle:double>")
    def nearest(embedding: pa.Array) -> pa.Array:
        cell, angle = [np.zeros(0, np.int64)], [np.zeros(0)]
        for _, angles in _angles(embedding, shared.value):
            cell.append(angles.argmin(1))
            angle.append(angles.min(1))
        cells = pa.array(np.concatenate(cell).astype(np.int32))
        return pa.StructArray.from_arrays([cells, pa.array(np.concatenate(angle))], names=["cell", "angle"])

    placed = rows.withColumn("_p", nearest("embedding")).select(*rows.columns, "_p.cell", F.col("_p.angle").alias("_angle"))
    placed = materialize(placed, "pivot-cells")
    # one row per pivot, which are broadcast too
    stats = placed.groupBy("cell").agg(F.min("_angle").alias("a"), F.max("_angle").alias("b"), F.count("*").alias("n"))
    near, far, sizes = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for r in stats.collect():
        near[r.cell], far[r.cell], sizes[r.cell] = r.a, r.b, r.n
    return PivotIndex(placed.drop("_angle"), pivots, near, far, sizes)


@dataclass
class Groups:
    """Cells put together: `order` has them by group, group g from `starts`[g];
    `cuts`[g] pieces hold its rows, the first of them numbered `first`[g]."""

    order: np.ndarray
    starts: np.ndarray
    cuts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.cuts) - self.cuts

    def of(self, cells: np.ndarray) -> list[np.ndarray]:
        """Pieces that hold some of the cells marked in each row."""
        held = np.logical_or.reduceat(cells[:, self.order], self.starts, axis=1)
        return [np.flatnonzero(row) for row in np.repeat(held, self.cuts, axis=1)]


def group_cells(pivots: np.ndarray, sizes: np.ndarray, rows: int) -> Groups:
    """Groups of up to `rows` rows, by halving along the direction in which the
    pivots differ most. A cell with more rows is a group in pieces."""
    groups, open_ = [], [np.flatnonzero(sizes > 0)]
    while open_:
        cells = open_.pop()
        held = sizes[cells].sum()
        if held <= rows or len(cells) == 1:
            groups.append((cells, max(1, -(-held // rows))))
            continue
        x = pivots[cells] - pivots[cells].mean(0)
        cells = cells[np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")]
        half = np.searchsorted(np.cumsum(sizes[cells]), held / 2) + 1
        half = min(max(1, half), len(cells) - 1)
        open_ += [cells[half:], cells[:half]]
    lengths = np.array([len(cells) for cells, _ in groups])
    order = np.concatenate([cells for cells, _ in groups])
    return Groups(order, np.cumsum(lengths) - lengths, np.array([n for _, n in groups]))


def _marked(lists: pa.Array | pa.ChunkedArray, cells: np.ndarray) -> np.ndarray:
    """Which of some (sorted) cells are in each list."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values, lengths = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
    row, at = np.repeat(np.arange(len(lists)), lengths), np.searchsorted(cells, values)
    here = np.append(cells, -1)[at] == values
    out = np.zeros((len(lists), len(cells)), bool)
    out[row[here], at[here]] = True
    return out


def _bounds(angles: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """No row of a cell is at a smaller distance."""
    return 1.0 - np.cos(np.maximum(np.maximum(angles - far, near - angles) - SLACK, 0.0))


def pivot_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    exclude_own: bool = False,
    cells: int | None = None,
    index: PivotIndex | None = None,
    max_matrix_bytes: int = MAX_MATRIX_BYTES,
) -> DataFrame:
    """query_id, vec_id, label, distance, rank of the k nearest corpus rows."""
    if k < 1:
        raise ValueError("k must be at least 1")
    index = index or build_pivots(corpus, choose_pivots(corpus, cells), exclude_own)
    if not len(index.pivots):
        return similarity_join(queries, corpus, k, exclude_own)
    asked = materialize(slim(queries, "query_id", exclude_own), "queries")
    spark, dim, held = asked.sparkSession, index.pivots.shape[1], int(index.sizes.sum())
    rows = max(1, max_matrix_bytes // (8 * dim))
    room = max(rows, MAX_MATRIX_BYTES // (8 * dim))
    # as many groups as parts of the queries make the fewest rows to send; halves
    # are not quite equal
    group = min(room, max(min(rows, LEAST_ROWS), -(-held * 5 // (4 * MAX_PIECES))))
    groups = group_cells(index.pivots, index.sizes, group)
    shared = spark.sparkContext.broadcast((index.pivots, index.near, index.far, index.sizes, groups))

    @F.arrow_udf("struct<first:array<int>,pieces:array<int>>")
    def first_cells(embedding: pa.Array) -> pa.Array:
        """The nearest cells that together hold more than k rows."""
        pivots, _, _, sizes, groups = shared.value
        first, pieces = [], []
        for _, angles in _angles(embedding, pivots):
            order = np.argsort(angles, axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            marked = np.zeros(angles.shape, bool)
            np.put_along_axis(marked, order, np.pad(held[:, :-1] <= k, ((0, 0), (1, 0)), constant_values=True), 1)
            marked &= sizes > 0
            first += [np.flatnonzero(row) for row in marked]
            pieces += groups.of(marked)
        return pa.StructArray.from_arrays([_int_lists(first), _int_lists(pieces)], names=["first", "pieces"])

    @F.arrow_udf("array<int>")
    def other_pieces(embedding: pa.Array, limit: pa.Array, done: pa.Array) -> pa.Array:
        """Where there are further cells that may hold a row within the limit."""
        pivots, near, far, _, groups = shared.value
        limits, every, out = np.asarray(limit, float), np.arange(len(pivots)), []
        for at, angles in _angles(embedding, pivots):
            some = slice(at, at + BLOCK)
            open_ = _bounds(angles, near, far) <= limits[some, None] + ROUNDING
            out += groups.of(open_ & ~_marked(done[some], every))
        return _int_lists(out)

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        """The first cells of queries without a limit, the others of those with
        one: as far as they are here."""
        pivots, near, far, _, _ = shared.value
        q = pa.Table.from_struct_array(q["q"])
        best, searched = _Best(_ids(q["query_id"]), unit_matrix(q["embedding"], dim), _own(q), k), 0
        if len(q) and len(c):
            c = c.sort_by("cell")
            cells, starts = np.unique(np.asarray(c["cell"]), return_index=True)
            stops, offered = np.append(starts[1:], len(c)), _Rows(c, dim)
            best.widen(len(c))
            later = "_limit" in q.column_names
            if later:
                best.limit[:] = np.asarray(q["_limit"])
            size = max(QUERIES, BOUNDS // len(cells))

            def lists(at: int) -> Iterator[tuple[int, int, np.ndarray]]:
                some = slice(at, at + size)
                open_ = _marked(q["_first"][some], cells) ^ later
                if later:
                    angles = np.arccos(np.clip(best.matrix[some] @ pivots[cells].T, -1.0, 1.0))
                    bounds = _bounds(angles, near[cells], far[cells])
                for i, (start, stop) in enumerate(zip(starts, stops)):
                    wanted = open_[:, i]
                    if later:
                        wanted = wanted & (bounds[:, i] <= best.limit[some] + ROUNDING)
                    yield start, stop, at + np.flatnonzero(wanted)

            for at in range(0, len(q), size):
                searched += best.offer_some(offered, lists(at))
        out = {n: pa.concat_arrays([x, pa.nulls(1, x.type)]) for n, x in best.table().items()}
        counts = np.zeros(len(out["query_id"]), np.int64)
        counts[-1] = searched
        return pa.table(out | {"searched": pa.array(counts)})

    # what a cell's rows are dealt over
    at = np.repeat(np.arange(len(groups.starts)), np.diff(np.append(groups.starts, len(groups.order))))
    cuts = zip(groups.order.tolist(), groups.first[at].tolist(), groups.cuts[at].tolist())
    cuts = F.broadcast(spark.createDataFrame(list(cuts), "cell int, _at int, _n int"))
    piece = F.col("_at") + F.pmod(F.xxhash64("vec_id"), F.col("_n"))
    placed = index.members.join(cuts, "cell").withColumn("_piece", piece.cast("int")).drop("_at", "_n")
    n, pieces = asked.count(), int(groups.cuts.sum())

    def searched(probed: DataFrame, tasks: int) -> DataFrame:
        """Queries are cut until there are that many tasks, if a part keeps
        enough rows; the corpus goes to all parts."""
        parts = max(1, -(-n // room), min(-(-tasks // pieces), n // LEAST_ROWS))
        left = probed.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        right = placed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        found = materialize(cogrouped(left, right, ["_piece", "_part"], search, COUNTED), "found")
        index.searched += found.agg(F.sum("searched")).first()[0] or 0
        return found.filter("query_id is not null").drop("searched")

    directed = _directed(asked).withColumn("_p", first_cells("embedding"))
    directed = directed.withColumn("_first", F.col("_p.first")).withColumn("_pieces", F.col("_p.pieces")).drop("_p")
    directed = materialize(directed, "queries")
    index.possible += directed.count() * int((index.sizes > 0).sum())
    # the first search is little work, and a task of each core enough for it
    cores = spark.sparkContext.defaultParallelism
    found = searched(directed.withColumn("_piece", F.explode("_pieces")).drop("_pieces"), min(CELLS, cores))
    best = top_k_per_query(found, k)
    # below k rows there is no limit, and every cell is open
    limit = best.groupBy("query_id").agg(F.max("distance").alias("_limit"), F.count("distance").alias("_n"))
    limit = limit.select("query_id", F.when(F.col("_n") == k, F.col("_limit")).alias("_limit"))
    none = F.coalesce("_limit", F.lit(float("inf")))
    open_ = directed.drop("_pieces").join(limit, "query_id", "left").withColumn("_limit", none)
    open_ = open_.withColumn("_piece", F.explode(other_pieces("embedding", "_limit", "_first")))
    more = searched(open_, CELLS)
    whole = materialize(top_k_per_query(found.unionByName(more), k), "nearest")
    full = whole.groupBy("query_id").agg(F.count("distance").alias("_n")).filter(F.col("_n") == k)
    rest = materialize(asked.join(full, "query_id", "left_anti"), "queries")
    if rest.isEmpty():
        return whole
    plain = similarity_join(rest, corpus, k, exclude_own, max_matrix_bytes)
    return whole.join(full.select("query_id"), "query_id", "left_semi").unionByName(plain.select(*whole.columns))
