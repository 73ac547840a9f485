"""Costly rows of few splits are dealt over all cores; files of many tasks."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from factlake.functions.encoders import hashing_encoder
from factlake.plans import index
from factlake.schemas import NEWS
from factlake.sources import news as src


def test_files_are_written_by_all_tasks_and_read_below_a_folder(spark, tmp_path):
    rows = [(i, f"text {i}\nsecond é") for i in range(40)]
    one = spark.createDataFrame(rows, "page_id long, text string").coalesce(1)
    path = str(tmp_path / "files")
    src.write_files(one, "page_id", path)
    names = [f for _, _, fs in os.walk(path) for f in fs if f.endswith(".txt")]
    # the number of the task is part of a file's name
    assert len(names) == 40 and len({n.split("-")[1] for n in names}) > 3
    read = src.read_documents(spark, path, recursive=True)
    page = F.regexp_extract("path", r"page_id=(\d+)", 1).cast("long")
    assert sorted(read.select(page, "text").collect()) == [(i, t + "\n") for i, t in rows]


def tree(path):
    """Folder and bytes of every file below."""
    found = []
    for folder, _, names in os.walk(path):
        for n in names:
            if n.startswith("part-"):
                raw = open(f"{folder}/{n}", "rb").read()
                found.append((os.path.relpath(folder, path), gzip.decompress(raw) if n.endswith(".gz") else raw))
    return sorted(found)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_files_are_those_of_the_partitioned_writer(spark, tmp_path, compression):
    rows = [(None, "no key"), ("", "empty"), ("a/b=c %", "é"), ("two", "x"), ("two", "x"), ("null", None)]
    df = spark.createDataFrame(rows, "k string, text string")
    src.write_files(df, "k", str(tmp_path / "own"), compression)
    df.repartition(4, "k").write.option("compression", compression).partitionBy("k").text(str(tmp_path / "spark"))
    assert tree(tmp_path / "own") == tree(tmp_path / "spark")
    # nothing beside them: no sums, no half-written files
    names = {n for _, _, fs in os.walk(tmp_path / "own") for n in fs if not n.startswith("part-")}
    assert names - {"._SUCCESS.crc"} == {"_SUCCESS"}
    with pytest.raises(FileExistsError):
        src.write_files(df, "k", str(tmp_path / "own"), compression)


def test_many_files_are_few_tasks_and_read_once(spark, tmp_path):
    """Tasks used to grow with the files, 32 in each, and every kind read all."""
    rows = [(i, f"text {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, text string")
    path = str(tmp_path / "files")
    src.write_files(df.filter("page_id % 2 = 1"), "page_id", f"{path}/plain")
    src.write_files(df.filter("page_id % 2 = 0"), "page_id", f"{path}/packed", "gzip")
    for name in ("_hidden", ".hidden", "empty"):
        (tmp_path / "files" / name).write_bytes(b"" if name == "empty" else b"x")
    read = src.read_documents(spark, path, {"gz": lambda b: gzip.decompress(b).decode()}, recursive=True)
    assert read.rdd.getNumPartitions() <= 8
    # one pass reads, whatever the kinds
    assert read._jdf.queryExecution().optimizedPlan().toString().count("_contents(") == 1
    page = F.regexp_extract("path", r"page_id=(\d+)", 1).cast("long")
    assert sorted(read.select(page, "text").collect()) == [(i, t + "\n") for i, t in rows]
    spark_paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    assert sorted(spark_paths.collect()) == sorted(read.select("path").collect())


def test_one_arrived_file_is_embedded_by_many_tasks(spark):
    rows = [(i, "title", f"text number {i}", i % 2, "train") for i in range(64)]
    batch = spark.createDataFrame(rows, NEWS).coalesce(1)
    made = index.kb_rows(batch, {"EMB-A": hashing_encoder(0)})
    assert made.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism
    assert made.filter("chunking = 'CHUNK-A'").count() == 64
