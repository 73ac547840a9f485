"""Incremental indexing of arriving articles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from factlake.operators.scoring import Encoder
from factlake.plans.index import kb_rows
from factlake.schemas import NEWS
from factlake.sources.growing_index import insert_batch
from factlake.sources.kb import read_batch, with_vec_id, write_kb


def news_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(NEWS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def index_stream(
    news: DataFrame,
    path: str,
    encoders: Mapping[str, Encoder],
    checkpoint: str,
    index_root: str | None = None,
    lists: int | None = None,
) -> StreamingQuery:
    """Indexes what has arrived and stops. The folder of a batch is named by its
    number, so a batch that is run again after a failure replaces itself. With
    `index_root` the batch goes into the inverted lists of its variants as well,
    where a commit of its name counts once."""

    def write(batch: DataFrame, number: int) -> None:
        name = f"stream-{number:012d}"
        write_kb(kb_rows(batch, encoders), path, name)
        if index_root:
            insert_batch(with_vec_id(read_batch(batch.sparkSession, path, name)), index_root, name, lists)

    return (
        news.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
