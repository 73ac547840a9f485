"""Helpers shared by the text operators: batches of bounded size, a bounded
memory of what text units encode to, and ragged arrays."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1_000_000
# Arrow batches of texts, unless the session says otherwise.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SMALL_BATCH, DEFAULT_BATCH = 4_000_000, ("64MB", "67108864", "67108864b")
# Units whose codes a worker remembers: about 250 bytes each.
REMEMBERED = 700_000


def ship(spark: SparkSession) -> None:
    """Python workers find this package wherever the driver was started, and
    get texts in small batches."""
    if spark.conf.get(BATCH_BYTES) in DEFAULT_BATCH:
        spark.conf.set(BATCH_BYTES, str(SMALL_BATCH))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))
    spark.sparkContext.environment["PYTHONPATH"] = os.environ["PYTHONPATH"]


def release() -> None:
    """Give memory that is free back to the machine: a Python worker lives on
    after its task, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: it frees memory by itself or not at all


def text_chunks(
    batches: Iterable[pa.RecordBatch], column: str, size: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Row slices whose texts (null: empty) hold about `size` bytes at most, or
    one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(np.asarray(lengths, np.int64))
        first = before = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
            part = batch.slice(first, last - first)
            yield part, [x or "" for x in part.column(column).to_pylist()]
            first, before = last, int(ends[last - 1])
    release()


def fields(df: DataFrame, names: Sequence[str]) -> str:
    """Schema text of the named columns, as they are."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


class UnitTable:
    """What text units (words or parts of them) encode to. `encode` maps a list
    of units to (all ids one after the other, number of ids of each unit).

    At most `max_units` units are remembered; then the table starts anew, so a
    worker's memory is bounded. The ids do not depend on what is remembered.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
        max_units: int = REMEMBERED,
        long_unit: int = 100,
    ) -> None:
        self._encode, self._max, self._long = encode, max_units, long_unit
        self._clear()

    def _clear(self) -> None:
        self._at: dict[str, int] = {}
        self._sizes = np.zeros(1 << 12, np.int64)
        self._starts = np.zeros(1 << 12, np.int64)
        self._pool = np.zeros(1 << 14, np.int32)
        self._used = self._count = 0

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.resize(array, max(size, 2 * len(array)))

    def _learn(self, units: list[str]) -> None:
        ids, sizes = self._encode(units)
        n, at = len(units), self._count
        self._sizes = self._room(self._sizes, at + n)
        self._starts = self._room(self._starts, at + n)
        self._pool = self._room(self._pool, self._used + len(ids))
        self._sizes[at : at + n] = sizes
        self._starts[at : at + n] = self._used + np.cumsum(sizes) - sizes
        self._pool[self._used : self._used + len(ids)] = ids
        self._at.update(zip(units, range(at, at + n)))
        self._used += len(ids)
        self._count += n

    def find(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each unit in the table, and units per part. Valid until
        the next call."""
        seen = set(chain.from_iterable(parts))
        missing = [u for u in seen if u not in self._at]
        if self._count + len(missing) > self._max and self._count:
            self._clear()
            missing = list(seen)
        if missing:
            self._learn(missing)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        found = map(self._at.__getitem__, chain.from_iterable(parts))
        at = np.fromiter(found, np.int64, int(counts.sum()))
        for u in [u for u in missing if len(u) > self._long]:
            del self._at[u]
        return at, counts

    def sizes(self, at: np.ndarray) -> np.ndarray:
        return self._sizes[at]

    def ids(self, at: np.ndarray) -> np.ndarray:
        return self._pool[ragged(self._starts[at], self._sizes[at])]


def sum_by(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of runs of `counts` values each."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
