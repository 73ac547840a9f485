"""Committed folders on the file system that the session uses, and many small
files below a folder.

Hadoop's class for local (or mounted) file systems starts processes for every
file that it makes, and Spark lists every folder in a task of its own. There,
tasks make, list and read files by themselves; other stores go through Spark.
"""

from __future__ import annotations

import gzip
import os
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.operators.scale import materialize

# Suffixes of what `write_texts` can write.
SUFFIXES = {"none": "", "uncompressed": "", "gzip": ".gz"}
# What Spark writes as %XX in the name of a partition's folder.
ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
# Bytes of files that a task reads at a time, and in all.
READ_BYTES, TASK_BYTES = 4 << 20, 64 << 20


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def is_committed(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder has finished."""
    fs, at = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def committed_folders(spark: SparkSession, root: str, prefix: str) -> dict[str, str]:
    """Finished folders `prefix`=value below `root`: value to path."""
    fs, at = _path(spark, root)
    if not fs.exists(at):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    values = [n.split("=", 1)[1] for n in names if n.startswith(f"{prefix}=")]
    paths = {v: f"{root}/{prefix}={v}" for v in sorted(values)}
    return {v: p for v, p in paths.items() if is_committed(spark, p)}


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path for file calls, if it is on a local or mounted file system."""
    fs, at = _path(spark, path)
    uri = fs.makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The same of a folder that is there."""
    fs, at = _path(spark, path)
    there = fs.exists(at) and fs.getFileStatus(at).isDirectory()
    return local_path(spark, path) if there else None


def small_tasks(spark: SparkSession) -> int:
    """Tasks for rows that cost much and weigh little."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, parts)


def _folder(key: str, value: str | None) -> str:
    """Name of a partition's folder, as Spark writes it."""
    key, name = (ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", x or "") for x in (key, value))
    return f"{key}={name or '__HIVE_DEFAULT_PARTITION__'}"


def write_texts(df: DataFrame, key: str, path: str, compression: str) -> None:
    """What Spark's partitioned text writer writes below a local folder, made by
    the tasks themselves. A file gets its name when it is whole, the folder its
    `_SUCCESS` when all are; an attempt that is repeated replaces its files."""
    spark = df.sparkSession
    fs, at = _path(spark, path)
    if fs.exists(at):
        raise FileExistsError(path)
    fs.mkdirs(at)
    (text,) = [c for c in df.columns if c != key]
    root, job, suffix = local_path(spark, path), uuid.uuid4(), SUFFIXES[compression]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{job}.c000.txt{suffix}"
        hidden = f".{name}.{task.taskAttemptId()}"
        files, last, raw, out = 0, None, None, None

        def finish() -> None:
            if last is None:
                return
            if out is not raw:
                out.close()
            raw.close()
            os.replace(f"{last}/{hidden}", f"{last}/{name}")

        for batch in batches:
            for value, content in zip(*(c.to_pylist() for c in batch.columns)):
                folder = f"{root}/{_folder(key, value)}"
                if folder != last:
                    finish()
                    os.makedirs(folder, exist_ok=True)
                    raw = out = open(f"{folder}/{hidden}", "wb")
                    if suffix:
                        out = gzip.GzipFile("", "wb", 6, raw, mtime=0)
                    files, last = files + 1, folder
                out.write((content or b"") + b"\n")
        finish()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    rows = df.repartition(small_tasks(spark), key)
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("text"))
    # neighbours have one folder: NULL and '' share theirs, and are sorted side by side
    rows.sortWithinPartitions("key").mapInArrow(write, "files long").agg(F.sum("files")).collect()
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")).close()


def _seen(name: str) -> bool:
    """Whether Spark reads files and folders of this name."""
    hidden = name.startswith(".") or name.endswith("._COPYING_")
    return not hidden and (not name.startswith("_") or "=" in name)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is in some folders: path, size, NULL for a folder."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        paths, sizes = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_pydict(
            {"path": pa.array(paths, pa.string()), "size": pa.array(sizes, pa.int64())}
        )

    rows = []
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            with os.scandir(folder) as found:
                for e in found:
                    if _seen(e.name):
                        rows.append((e.path, None if e.is_dir() else e.stat().st_size))
                    if len(rows) >= 10_000:
                        yield table(rows)
                        rows = []
    yield table(rows)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, size of all files below a local folder that are not empty, which
    Spark leaves out too. Each level is listed by the tasks of one job, and no
    list of files comes to the driver."""
    level, files = spark.createDataFrame([(folder,)], "path string"), []
    while level is not None:
        entries = materialize(level.mapInArrow(_entries, "path string, size long"), "files")
        files.append(entries.filter("size > 0"))
        folders = entries.filter("size is null").select("path")
        level = None if folders.isEmpty() else folders.repartition(small_tasks(spark), "path")
    return reduce(DataFrame.unionByName, files)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path as Spark names it and content of files, a few MB at a time."""

    def table(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"path": pa.array(paths, pa.string()), "content": pa.array(contents, pa.binary())}
        )

    paths, contents, size = [], [], 0
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with open(path, "rb") as f:
                contents.append(f.read())
            paths.append(f"file:{path}")
            size += len(contents[-1])
            if size >= READ_BYTES or len(paths) >= 10_000:
                yield table(paths, contents)
                paths, contents, size = [], [], 0
    yield table(paths, contents)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of all files below a local folder, dealt over as many tasks
    as their number and their bytes ask for."""
    files = list_files(spark, folder)
    size = files.agg(F.sum("size")).first()[0] or 0
    tasks = max(small_tasks(spark), -(-size // TASK_BYTES))
    return files.select("path").repartition(tasks, "path").mapInArrow(_contents, "path string, content binary")
