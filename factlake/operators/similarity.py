"""Exact cosine top-k of many queries against a corpus of vectors.

Expected on each side: an id (`query_id` / `vec_id`), an `embedding` and, to
leave out corpus rows of the query's own document, `source_index`. A `label`
of the corpus comes back with its row, which saves a join. The distances of a
block of corpus rows to a block of queries are one matrix product; only the k
best per query leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.functions.vectors import DISTANCE_DIGITS, cosine_distance
from factlake.operators.scale import top_n_per_group

BLOCK = 1024
# Queries of a block, so that its products stay in a core's cache.
QUERIES = 256
# Two distances that round to the same number differ by less than this.
ROUNDING = 2 * 10.0**-DISTANCE_DIGITS
# A broadcast query matrix and one side of a shuffled cell stay below this.
MAX_MATRIX_BYTES = 64 << 20
# A side is cut into more pieces than this only if a task could not hold them.
MAX_PIECES = 8
# Queries are cut until there are this many cells, if a piece keeps that many rows.
CELLS, LEAST_ROWS = 64, 4096
PAIRS = "query_id long, vec_id long, label int, distance double"


def unit_matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows scaled to unit length; NaN rows for NULL and zero vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.full((len(column), dim), np.nan)
    present = column.drop_null()
    values = np.asarray(present.flatten(), dtype=np.float64)
    if values.size != len(present) * dim:
        raise ValueError(f"every embedding must have {dim} numbers")
    rows = values.reshape(-1, dim)
    length = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    with np.errstate(invalid="ignore", divide="ignore"):
        out[~np.asarray(column.is_null())] = rows / length
    return out


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column, dtype=np.int64)


def _kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    return np.partition(values, -k, axis=1)[:, -k]


def _pairs(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the true entries, by rows. Few of many are looked for
    eight at a time."""
    flat = near.reshape(-1)
    if flat.size % 8:
        return np.divmod(np.flatnonzero(flat), near.shape[1])
    at = np.flatnonzero(flat.view(np.uint64))
    eight, one = np.nonzero(flat.reshape(-1, 8)[at])
    return np.divmod(at[eight] * 8 + one, near.shape[1])


class _Rows:
    """Rows of the corpus as arrays, as they are offered."""

    def __init__(self, corpus: pa.Table | pa.RecordBatch, dim: int):
        self.vec, self.label, self.own = _ids(corpus.column("vec_id")), _labels(corpus), _own(corpus)
        self.matrix = unit_matrix(corpus.column("embedding"), dim)
        self.single, self.unknown = self.matrix.astype(np.float32), np.isnan(self.matrix).any(1)


class _Best:
    """The k nearest rows seen so far for every query of a matrix, in order: the
    first `count` entries of its row. Pairs are compared in single precision
    with the k-th distance, less what that may be off by; the few that pass are
    computed again, rounded, and merged into the rows of their queries only."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, own: np.ndarray | None, k: int):
        self.ids, self.matrix, self.own, self.k = ids, matrix, own, k
        self.single = matrix.astype(np.float32)
        self.slack = (matrix.shape[1] + 8) * float(np.finfo(np.float32).eps)
        self.seen = 0
        self.count = np.zeros(len(ids), np.int64)
        self.vec = np.empty((len(ids), 0), np.int64)
        self.label = np.empty((len(ids), 0))
        self.distance = np.empty((len(ids), 0))
        self.limit = np.full(len(ids), np.inf)
        self.limit_id = np.full(len(ids), np.iinfo(np.int64).max)
        self.unknown = np.isnan(matrix).any(1)
        self.products = np.empty((QUERIES, BLOCK), np.float32)

    def offer(self, corpus: pa.Table | pa.RecordBatch) -> None:
        rows = _Rows(corpus, self.matrix.shape[1])
        self.widen(len(rows.vec))
        for q in range(0, len(self.ids), QUERIES):
            part = slice(q, q + QUERIES)
            held, waiting = [], 0
            for c in range(0, len(rows.vec), BLOCK):
                near = self._block(part, rows, slice(c, c + BLOCK))
                held.append((near[0] + q, near[1] + c, near[2]))
                waiting += len(near[0])
                # Few pairs wait for the next blocks', as a merge costs the same for many
                if waiting >= len(self.ids[part]) * self.k or (waiting and c + BLOCK >= len(rows.vec)):
                    self._merge(held, rows)
                    held, waiting = [], 0

    def offer_some(self, rows: _Rows, lists: Iterable[tuple[int, int, np.ndarray]]) -> int:
        """Offers rows from one place to another to some of the queries, for each
        of `lists`, whose queries may depend on what was found before. Returns
        how many pairs of a list and a query there were."""
        held, waiting, asked = [], 0, 0
        for start, stop, queries in lists:
            asked += len(queries)
            for q in range(0, len(queries), QUERIES):
                part = queries[q : q + QUERIES]
                for c in range(start, stop, BLOCK):
                    near = self._block(part, rows, slice(c, min(c + BLOCK, stop)))
                    if len(near[0]):
                        held.append((part[near[0]], near[1] + c, near[2]))
                        waiting += len(near[0])
            if waiting >= QUERIES * self.k:
                self._merge(held, rows)
                held, waiting = [], 0
        if waiting:
            self._merge(held, rows)
        return asked

    def _block(self, part: slice | np.ndarray, rows: _Rows, some: slice):
        """Query, row and distance of the pairs of a block that may be among
        the best, both counted from the block's first."""
        near = None
        if not self.unknown[part].any() and not rows.unknown[some].any():
            near = self._near(part, rows.matrix[some], rows.single[some])
        if near is None:
            near = self._near_of_all(part, rows.matrix[some], None if rows.own is None else rows.own[some])
        return near

    def widen(self, rows: int) -> None:
        """Room for as many entries as there can be by now."""
        self.seen += rows
        more = min(self.k, self.seen) - self.vec.shape[1]
        if more > 0:
            self.vec, self.label, self.distance = (
                np.concatenate([a, np.zeros((len(a), more), a.dtype)], axis=1)
                for a in (self.vec, self.label, self.distance)
            )

    def _near(self, part: slice | np.ndarray, rows: np.ndarray, single: np.ndarray):
        """Query, row and distance of the pairs of a block that may be among
        the best; None if these are too many to be computed one by one."""
        least = 1.0 - self.limit[part] - ROUNDING
        products = self.products[: len(least), : len(single)]
        np.matmul(self.single[part], single.T, out=products)
        # Most queries have nothing near in a block, as their largest product tells
        single_least = (least - self.slack).astype(np.float32)
        some = np.flatnonzero(products.max(axis=1) >= single_least)
        near = products[some] >= single_least[some, None]
        if np.count_nonzero(near) > products.size // 64:
            return None
        q, c = _pairs(near)
        q = some[q]
        similar = np.einsum("ij,ij->i", self.matrix[part][q], rows[c])
        kept = similar >= least[q]
        return q[kept], c[kept], np.round(1.0 - similar[kept], DISTANCE_DIGITS)

    def _near_of_all(self, part: slice | np.ndarray, rows: np.ndarray, own: np.ndarray | None):
        """The same in double precision, with vectors of no direction."""
        similar = self.matrix[part] @ rows.T
        limit = self.limit[part, None]
        near = similar >= 1.0 - limit - ROUNDING
        unknown = np.isnan(similar[:, 0]).any() or np.isnan(similar[0]).any()
        if unknown:
            near |= np.isnan(similar) & np.isinf(limit)
        if near.sum(axis=1).max() > 4 * self.k and near.shape[1] > self.k:
            if own is not None:
                near &= self.own[part, None] != own
            kth = _kth_largest(np.where(near & ~np.isnan(similar), similar, -np.inf), self.k)
            enough = np.isfinite(kth)
            near[enough] &= similar[enough] >= kth[enough, None] - ROUNDING
        q, c = _pairs(near)
        d = np.round(1.0 - similar[q, c], DISTANCE_DIGITS)
        d[np.isnan(d)] = np.inf
        return q, c, d

    def _merge(self, held: list[tuple], rows: _Rows) -> None:
        q, c, d = (np.concatenate(x) for x in zip(*held))
        vec, label, own = rows.vec, rows.label, rows.own
        limit, limit_id = self.limit[q], self.limit_id[q]
        better = (d < limit) | ((d == limit) & (vec[c] < limit_id))
        if own is not None:
            better &= self.own[q] != own[c]
        q, c, d = q[better], c[better], d[better]
        if len(q) == 0:
            return
        touched = np.unique(q)
        held, place = self._entries(touched)
        query = np.concatenate([held, q])
        ids = np.concatenate([self.vec[held, place], vec[c]])
        labels = np.concatenate([self.label[held, place], label[c]])
        distance = np.concatenate([self.distance[held, place], d])
        order = np.lexsort((ids, distance, query))
        query, ids, labels, distance = query[order], ids[order], labels[order], distance[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best, full = place < self.k, place == self.k - 1
        self.limit[query[full]] = distance[full]
        self.limit_id[query[full]] = ids[full]
        query, place = query[best], place[best]
        self.vec[query, place] = ids[best]
        self.label[query, place] = labels[best]
        self.distance[query, place] = distance[best]
        self.count[query] = place + 1  # the last one counts

    def _entries(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and place of all entries of some queries."""
        n = self.count[queries]
        return np.repeat(queries, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def table(self) -> dict[str, pa.Array]:
        at = self._entries(np.arange(len(self.ids)))
        distance, label = self.distance[at], self.label[at]
        return {
            "query_id": pa.array(self.ids[at[0]], pa.int64()),
            "vec_id": pa.array(self.vec[at], pa.int64()),
            "label": pa.array(label, pa.float64(), mask=np.isnan(label)).cast(pa.int32()),
            "distance": pa.array(distance, pa.float64(), mask=np.isinf(distance)),
        }


def _own(table: pa.Table | pa.RecordBatch) -> np.ndarray | None:
    names = table.schema.names
    return _ids(table.column("source_index")) if "source_index" in names else None


def _labels(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """NaN where there is no label."""
    if "label" not in table.schema.names:
        return np.full(table.num_rows, np.nan)
    return np.asarray(table.column("label").cast(pa.float64()).to_pandas(), dtype=np.float64)


def _dim(df: DataFrame) -> int:
    """0 when there is no vector."""
    row = df.filter("embedding is not null").select(F.size("embedding")).first()
    return row[0] if row else 0


def slim(df: DataFrame, key: str, own: bool, *more: str) -> DataFrame:
    extra = [F.col("source_index").cast("long")] if own else []
    if key == "vec_id" and "label" in df.columns:
        extra.append(F.col("label").cast("int"))
    return df.select(F.col(key).cast("long"), "embedding", *extra, *more)


def _against_broadcast(queries: pa.Table, corpus: DataFrame, k: int, dim: int) -> DataFrame:
    """Corpus stays where it is; every task holds the whole query matrix."""
    shared = corpus.sparkSession.sparkContext.broadcast(
        (_ids(queries["query_id"]), unit_matrix(queries["embedding"], dim), _own(queries))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, own = shared.value
        best = _Best(ids, matrix, own, k)
        for b in batches:
            best.offer(b)
        yield pa.RecordBatch.from_pydict(best.table())

    return corpus.mapInArrow(search, PAIRS)


CELL = ["cell", "_qp", "_cp"]


def _cut(df: DataFrame, key: str, mine: str, other: str, own: Column, others: Column) -> DataFrame:
    """Numbers a row's own piece and repeats it for every piece of the other
    side."""
    piece = F.pmod(F.xxhash64(key), own).cast("int")
    every = F.explode(F.sequence(F.lit(0), others - 1))
    return df.withColumn(mine, piece).withColumn(other, every)


def _room(df: DataFrame, rows_per_cell: int) -> int:
    """Rows of one side that a task can hold, whatever cells were asked for."""
    return max(rows_per_cell, MAX_MATRIX_BYTES // (8 * (_dim(df) or 1)))


def cut_whole(
    queries: DataFrame, corpus: DataFrame, rows_per_cell: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides as pieces of bounded size that all meet. Every row is
    repeated for each piece of the other side, so pieces smaller than a task
    can hold are not more than MAX_PIECES: the shuffle then grows as the rows,
    not as their square. Queries are cut further, as many tasks are needed to
    keep all cores busy; the corpus is not, as each of its pieces has its own k
    best of a query."""
    room = _room(corpus, rows_per_cell)

    def pieces(n: int) -> int:
        return max(1, -(-n // room), min(-(-n // rows_per_cell), MAX_PIECES))

    asked, held = queries.count(), corpus.count()
    nc = pieces(held)
    # Two pieces per side would be work for four tasks only
    more = min(-(-CELLS // nc), 2 * MAX_PIECES, asked // LEAST_ROWS)
    nq, nc = F.lit(max(pieces(asked), more)), F.lit(nc)
    return (
        _cut(queries.withColumn("cell", F.lit(0)), "query_id", "_qp", "_cp", nq, nc),
        _cut(corpus.withColumn("cell", F.lit(0)), "vec_id", "_cp", "_qp", nc, nq),
    )


def cut_lists(
    queries: DataFrame, corpus: DataFrame, rows_per_cell: int
) -> tuple[DataFrame, DataFrame]:
    """Pieces within each `cell`, so that a hot cell becomes many tasks; no
    more of them than in `cut_whole`."""
    room = _room(corpus, rows_per_cell)

    def pieces(df: DataFrame, name: str) -> DataFrame:
        n = F.count("*")
        few = F.least(F.ceil(n / rows_per_cell), F.lit(MAX_PIECES))
        return df.groupBy("cell").agg(F.greatest(F.ceil(n / room), few).cast("int").alias(name))

    # One row per list: as many as there are centroids, which are broadcast too.
    cuts = F.broadcast(pieces(queries, "_nq").join(pieces(corpus, "_nc"), "cell"))
    nq, nc = F.col("_nq"), F.col("_nc")
    left = _cut(queries.join(cuts, "cell"), "query_id", "_qp", "_cp", nq, nc)
    right = _cut(corpus.join(cuts, "cell"), "vec_id", "_cp", "_qp", nc, nq)
    return left.drop("_nq", "_nc"), right.drop("_nq", "_nc")


def best_in_cells(queries: DataFrame, corpus: DataFrame, k: int, dim: int) -> DataFrame:
    """Top-k per query within each cell of two cut sides. The query columns
    travel as one struct: both sides often come from the same table, and a
    cogroup mixes up columns that its sides share."""

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        q = pa.Table.from_struct_array(q["q"])
        best = _Best(_ids(q["query_id"]), unit_matrix(q["embedding"], dim), _own(q), k)
        if len(q) and len(c):
            best.offer(c)
        return pa.table(best.table())

    return cogrouped(queries, corpus, CELL, search, PAIRS)


def cogrouped(queries: DataFrame, corpus: DataFrame, keys: list[str], search: Callable, schema: str) -> DataFrame:
    """`search` of the queries (as the struct `q`) and the rows of each key."""
    packed = F.struct(*[c for c in queries.columns if c not in keys]).alias("q")
    # Few bytes are much work here: a given number of partitions is not put
    # together by the size of its rows
    spark = queries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, 4 * spark.sparkContext.defaultParallelism)
    left = queries.select(*keys, packed).repartition(parts, *keys).groupBy(*keys)
    right = corpus.repartition(parts, *keys).groupBy(*keys)
    return left.cogroup(right).applyInArrow(search, schema)


def top_k_per_query(pairs: DataFrame, k: int) -> DataFrame:
    """Nearest k per query; NULL distances last, ties by id."""
    order = [F.col("distance").asc_nulls_last(), F.col("vec_id")]
    return top_n_per_group(pairs, ["query_id"], order, k, spread_by="vec_id")


def similarity_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    exclude_own: bool = False,
    max_matrix_bytes: int = MAX_MATRIX_BYTES,
) -> DataFrame:
    """query_id, vec_id, label, distance, rank of the k nearest corpus rows."""
    if k < 1:
        raise ValueError("k must be at least 1")
    queries = slim(queries, "query_id", exclude_own)
    corpus = slim(corpus, "vec_id", exclude_own)
    dim = _dim(corpus) or _dim(queries) or 1
    rows = max(1, max_matrix_bytes // (8 * dim))
    head = queries.limit(rows + 1).toArrow()
    if len(head) <= rows:
        pairs = _against_broadcast(head, corpus, k, dim)
    else:
        pairs = best_in_cells(*cut_whole(queries, corpus, rows), k, dim)
    return top_k_per_query(pairs, k)


def search(corpus: DataFrame, vector: Sequence[float], k: int) -> DataFrame:
    """One query: order by distance, limit k. The vector is not returned."""
    wanted = F.array(*[F.lit(float(x)) for x in vector])
    distance = cosine_distance(F.col("embedding"), wanted)
    return (
        corpus.withColumn("distance", distance)
        .drop("embedding")
        .orderBy(F.col("distance").asc_nulls_last(), "vec_id")
        .limit(k)
    )
