"""Versions of the knowledge base: which batches there are, and what is gone.

A version is one small folder below `_versions`, a row for each batch and each
range of positions deleted from it. Reading takes the rows of the listed
batches that lie in none of its ranges, so a snapshot, a rollback and a restore
write no data, and any finished version stays readable. The current state is
the newest version and the batches finished since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.sources.files import committed_folders

# Positions first..last of a batch are gone (last NULL: all from first on), or
# nothing where first is NULL; NULL positions are gone if `unknown`.
STATE = "batch string, first bigint, last bigint, unknown boolean"
State = dict[str, set[tuple[int | None, int | None, bool]]]


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished versions, oldest first."""
    return sorted(committed_folders(spark, f"{path}/_versions", "version"))


def state_of(spark: SparkSession, path: str, version: str) -> State:
    """Batches of a version, and the ranges deleted from each."""
    rows = spark.read.schema(STATE).parquet(f"{path}/_versions/version={version}")
    out: State = {}
    for r in rows.collect():
        gone = out.setdefault(r.batch, set())
        if r.first is not None or r.unknown:
            gone.add((r.first, r.last, r.unknown))
    return out


def current_state(spark: SparkSession, path: str) -> State:
    known = versions(spark, path)
    finished = committed_folders(spark, path, "batch")
    if not known:
        return {batch: set() for batch in finished}
    state = state_of(spark, path, known[-1])
    # a batch that an older version holds, but not the newest, was restored away
    seen = {b for v in known[:-1] for b in state_of(spark, path, v)} - state.keys()
    return state | {b: set() for b in finished if b not in state and b not in seen}


def _write(spark: SparkSession, path: str, state: State) -> str:
    name = f"{len(versions(spark, path)):08d}"
    rows = [(b, *gone) for b, ranges in sorted(state.items()) for gone in sorted(ranges, key=str) or [(None, None, False)]]
    target = f"{path}/_versions/version={name}"
    spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(target)
    return name


def snapshot(spark: SparkSession, path: str) -> str:
    """Names the current state."""
    return _write(spark, path, current_state(spark, path))


def restore(spark: SparkSession, path: str, version: str) -> str:
    """Makes an earlier version the current state, as a new version. What was
    added since stays in the versions that hold it."""
    snapshot(spark, path)
    return _write(spark, path, state_of(spark, path, version))


def delete_range(spark: SparkSession, path: str, first: int, last: int | None = None, unknown: bool = False) -> str:
    """Deletes positions from all batches there are; what comes later is kept."""
    state = current_state(spark, path)
    return _write(spark, path, {b: gone | {(first, last, unknown)} for b, gone in state.items()})


def roll_back(spark: SparkSession, path: str, checkpoint: int) -> str:
    """Deletes later positions than the resume point, and NULL ones."""
    return delete_range(spark, path, checkpoint + 1, None, True)


def free_batch(spark: SparkSession, path: str, name: str) -> str:
    """`name`, or with a number behind it if a finished batch has it, whose
    files older versions may need."""
    finished, free, n = committed_folders(spark, path, "batch"), name, 1
    while free in finished:
        n += 1
        free = f"{name}.{n}"
    return free


def read_state(spark: SparkSession, path: str, state: State, schema) -> DataFrame | None:
    """The rows of a state; batches with the same ranges are read together."""
    groups: dict[frozenset, list[str]] = {}
    for batch, gone in state.items():
        groups.setdefault(frozenset(gone), []).append(f"{path}/batch={batch}")
    out = None
    for gone, folders in sorted(groups.items(), key=lambda g: g[1]):
        rows = spark.read.schema(schema).option("basePath", path).parquet(*sorted(folders)).select(*schema.names)
        at = F.col("source_index")
        for first, last, unknown in sorted(gone, key=str):
            if first is None:
                kept = at.isNotNull()
            else:
                kept = at < first if last is None else (at < first) | (at > last)
                kept = kept if unknown else kept | at.isNull()
            rows = rows.filter(kept)
        out = rows if out is None else out.unionByName(rows)
    return out
