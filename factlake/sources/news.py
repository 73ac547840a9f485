"""The labelled dataset and free-standing documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions.text import compose_content, strip_nul
from factlake.schemas import NEWS
from factlake.sources.files import (
    SUFFIXES,
    is_committed,
    local_folder,
    local_path,
    read_files,
    small_tasks,
    write_texts,
)

Decoder = Callable[[bytes], str]
SUFFIX = re.compile(r"\.([^./]+)$")


def cache_splits(df: DataFrame, path: str) -> str:
    """Writes the dataset once, one folder per split; later calls reuse it."""
    if not is_committed(df.sparkSession, path):
        columns = df.select(*NEWS.names)
        columns.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def read_news(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split with `content`; only that split's folder is read."""
    news = spark.read.schema(NEWS).parquet(path).where(F.col("split") == split)
    return news.withColumn("content", compose_content(F.col("title"), F.col("text")))


def write_files(df: DataFrame, key: str, path: str, compression: str = "none") -> None:
    """The text of every `key` as a file of its own, below `key`=value. The
    files are dealt over all tasks by a fixed number, as they cost much and
    weigh little, and every task moves its own files into place: the default
    commit moves one after the other on the driver."""
    spark = df.sparkSession
    if local_path(spark, path) and compression in SUFFIXES:
        return write_texts(df, key, path, compression)
    writer = df.repartition(small_tasks(spark), key).write.option("compression", compression)
    writer = writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy(key).text(path)


def read_documents(
    spark: SparkSession,
    glob: str,
    decoders: dict[str, Decoder] | None = None,
    recursive: bool = False,
) -> DataFrame:
    """path, text of the files that match, or of all files below a folder
    (`recursive`): many folders are then listed by tasks, where a pattern is
    resolved by the driver alone. Files whose suffix has a decoder (bytes to
    text) go through it; the others are UTF-8 text. Every file is read once."""
    folder = local_folder(spark, glob) if recursive else None
    if folder:
        files = read_files(spark, folder)
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
        files = reader.load(glob).select("path", "content")
    text = F.decode("content", "UTF-8")
    if decoders:

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                plain, texts = [], []
                for path, content in zip(*(batch.column(c).to_pylist() for c in ("path", "content"))):
                    suffix = SUFFIX.search(path)
                    decoder = decoders.get(suffix[1].lower()) if suffix else None
                    plain.append(None if decoder else content)
                    texts.append(decoder(content) if decoder else None)
                columns = {"content": pa.array(plain, pa.binary()), "text": pa.array(texts, pa.string())}
                yield pa.RecordBatch.from_pydict({"path": batch.column("path"), **columns})

        files = files.mapInArrow(decode, "path string, content binary, text string")
        text = F.coalesce("text", text)
    return files.select("path", strip_nul(text).alias("text"))
