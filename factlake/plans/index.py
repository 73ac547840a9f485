"""Corpus to knowledge base, resumable."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions.text import sliding_windows
from factlake.operators.chunking import with_document
from factlake.operators.grid import CHUNK_TYPE, CHUNKINGS
from factlake.operators.kb import index_checkpoint, pending_documents, rollback
from factlake.operators.scale import scratch_path
from factlake.operators.scoring import Encoder, embed_variants
from factlake.sources.growing_index import catch_up, insert_batch
from factlake.sources.kb import read_batch, read_kb, snapshot_kb, with_vec_id, write_kb
from factlake.sources.versions import free_batch, snapshot

# Rows per call of an encoder, and calls between two snapshots.
EMBED_BATCH = 128
SNAPSHOT_EVERY = 50
ROWS_PER_COMMIT = 1_000_000


def kb_rows(news: DataFrame, encoders: Mapping[str, Encoder]) -> DataFrame:
    """Rows of the knowledge base for every model and chunking. The articles
    are dealt over all cores first: a file that has just arrived, or a range of
    one commit, may be a single split, and the encoders are the costly part."""
    cores = news.sparkSession.sparkContext.defaultParallelism
    docs = with_document(news).select("source_index", "label", "content")
    docs = docs.repartition(2 * cores, "source_index")
    chunks = docs.select("source_index", "label", F.inline(F.concat(*map(_chunks, CHUNKINGS))))
    models = F.explode(F.array(*[F.lit(m) for m in encoders])).alias("embedding_model")
    return embed_variants(chunks.select("*", models), encoders, EMBED_BATCH)


def _chunks(chunking: str) -> Column:
    """All chunks of one kind, so that one scan makes those of every kind."""
    texts = F.array("content") if CHUNK_TYPE[chunking] == "full" else sliding_windows(F.col("content"))
    return F.transform(
        F.coalesce(texts, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(chunking).alias("chunking"), i.alias("chunk_no"), x.alias("content"))
    )


def variants_of(encoders: Mapping[str, Encoder]) -> list[tuple[str, str]]:
    return [(m, c) for m in encoders for c in CHUNKINGS]


def build_kb(
    news: DataFrame,
    path: str,
    encoders: Mapping[str, Encoder],
    rows_per_commit: int = ROWS_PER_COMMIT,
    snapshot_root: str | None = None,
    snapshot_every: int = SNAPSHOT_EVERY,
    index_root: str | None = None,
    lists: int | None = None,
) -> int:
    """Indexes the documents after the resume point, one commit for each range
    of `rows_per_commit` positions, all variants together. Returns the number
    of commits. A folder left unfinished by a crash is not read, and the range
    it belongs to is written again under the same name. Every `snapshot_every`
    commits the state is named as a version, which writes no data; with
    `snapshot_root` it is copied there as well. With `index_root` the
    inverted lists of every variant grow with each commit; batches that a killed
    run has written but not indexed come first."""
    spark = news.sparkSession
    if index_root:
        catch_up(spark, path, index_root, variants_of(encoders), lists=lists)
    reached = resume_point(spark, path, encoders)
    last = news.agg(F.max("source_index")).first()[0]
    if last is None or last <= reached:
        return 0
    ranges = _by_commit(pending_documents(news, reached), reached + 1, rows_per_commit)
    commits = 0
    for start in range(reached + 1, last + 1, rows_per_commit):
        part = spark.read.schema(news.schema).parquet(f"{ranges}/_commit={commits}")
        name = free_batch(spark, path, f"{start:012d}")
        write_kb(kb_rows(part, encoders), path, name)
        if index_root:
            insert_batch(with_vec_id(read_batch(spark, path, name)), index_root, name, lists)
        commits += 1
        if commits % snapshot_every == 0:
            snapshot(spark, path)
            if snapshot_root:
                snapshot_kb(read_kb(spark, path), snapshot_root)
    if snapshot_root:
        snapshot_kb(read_kb(spark, path), snapshot_root)
    return commits


def _by_commit(news: DataFrame, first: int, rows: int) -> str:
    """The documents in one folder per commit, so that each commit reads its
    own documents and no others. Positions are dense, so no folder is empty."""
    path = scratch_path(news.sparkSession, "pending")
    number = F.floor((F.col("source_index") - first) / rows).cast("long")
    ranged = news.withColumn("_commit", number).repartitionByRange("source_index")
    ranged.write.partitionBy("_commit").parquet(path)
    return path


def resume_point(spark: SparkSession, path: str, encoders: Mapping[str, Encoder]) -> int:
    """What every model has reached. A commit holds all chunkings, so whole
    articles tell: a blank article at the end has no windows."""
    whole = [(m, c) for m, c in variants_of(encoders) if CHUNK_TYPE[c] == "full"]
    return index_checkpoint(read_kb(spark, path), whole).first()["checkpoint"]


def consistent_kb(kb: DataFrame, variants: list[tuple[str, str]]) -> DataFrame:
    """The part of the knowledge base that every variant has reached."""
    return rollback(kb, index_checkpoint(kb, variants).first()["checkpoint"])
