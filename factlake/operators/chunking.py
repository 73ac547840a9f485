"""Articles to chunks, chunk ids, and the backfill of document positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions.text import compose_document, sliding_windows, window_count
from factlake.operators.scale import running_total

# Ids of one bin of a range join.
BIN_IDS = 64


def with_document(news: DataFrame) -> DataFrame:
    """Adds `content`: title, blank line, text."""
    return news.withColumn("content", compose_document(F.col("title"), F.col("text")))


def chunk_sliding(df: DataFrame, size: int = 256, overlap: int = 64) -> DataFrame:
    """One row per word window of `content`; other columns are carried along."""
    carried = [c for c in df.columns if c != "content"]
    windows = sliding_windows(F.col("content"), size, overlap)
    return df.select(*carried, F.posexplode(windows).alias("chunk_no", "content"))


def chunk_full(df: DataFrame) -> DataFrame:
    """The whole article as its only chunk."""
    carried = [c for c in df.columns if c != "content"]
    return df.select(*carried, F.lit(0).alias("chunk_no"), "content")


def chunk_counts(df: DataFrame, size: int = 256, overlap: int = 64) -> DataFrame:
    """Adds `n_chunks` without building the chunks."""
    return df.withColumn("n_chunks", window_count(F.col("content"), size, overlap))


def chunk_id_ranges(counts: DataFrame) -> DataFrame:
    """First and last chunk id of each document when ids count from 1 in
    document order. Needs dense `source_index` and `n_chunks`."""
    total = running_total(counts, [], "source_index", {"last_id": F.col("n_chunks")})
    return total.withColumn("first_id", F.col("last_id") - F.col("n_chunks") + 1)


def backfill_source_index(chunks: DataFrame, ranges: DataFrame, width: int = BIN_IDS) -> DataFrame:
    """Gives every chunk the document whose id range holds its `id`; none is
    NULL, and several ranges give several rows. Ranges are cut to bins of
    `width` ids, a row for each bin that they touch and none for each id; ids
    and ranges meet in their bin, where the ends decide."""
    bins = F.sequence(F.expr(f"first_id div {width}"), F.expr(f"last_id div {width}"))
    cut = ranges.filter("n_chunks > 0 AND first_id <= last_id").select(
        F.col("source_index").alias("_doc"), F.col("first_id").alias("_first"), F.col("last_id").alias("_last"),
        F.explode(bins).alias("_bin"),
    )
    own = chunks.drop("source_index")
    inside = F.expr(f"id div {width} = _bin AND id BETWEEN _first AND _last")
    return own.join(cut, inside, "left").select(*own.columns, F.col("_doc").alias("source_index"))


def backfill_full(chunks: DataFrame) -> DataFrame:
    """Whole articles have consecutive ids from 1."""
    return chunks.withColumn("source_index", F.col("id") - 1)
