"""State of the knowledge base: resume point, rollback, work left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.operators.scale import has_at_most


def index_checkpoint(kb: DataFrame, variants: Sequence[tuple[str, str]]) -> DataFrame:
    """One row: the largest `source_index` that every variant (model, chunking)
    has reached; a variant without rows counts as -1."""
    reached = kb.groupBy("embedding_model", "chunking").agg(
        F.max("source_index").alias("reached")
    )
    wanted = F.array(
        *[
            F.struct(F.lit(m).alias("embedding_model"), F.lit(c).alias("chunking"))
            for m, c in variants
        ]
    )
    one = kb.sparkSession.range(1).select(F.inline(wanted))
    least = F.min(F.coalesce("reached", F.lit(-1).cast("long")))
    return one.join(reached, ["embedding_model", "chunking"], "left").agg(
        least.alias("checkpoint")
    )


def rollback(kb: DataFrame, checkpoint: int) -> DataFrame:
    """Rows up to the resume point; later ones and NULL positions go."""
    return kb.filter(F.col("source_index") <= checkpoint)


def pending_documents(docs: DataFrame, checkpoint: int) -> DataFrame:
    """Documents after the resume point."""
    return docs.filter(F.col("source_index") > checkpoint)


# Bits of one of Spark's bitmaps, and bitmaps (4 kB) that may be broadcast.
BUCKET = 1 << 15
BROADCAST_BUCKETS = 5_000


def positions(df: DataFrame, *keys: str) -> DataFrame:
    """keys, bucket, bits: the `source_index` of all rows as bitmaps, which are
    put together in the tasks before they are shuffled."""
    at = F.col("source_index") + 1  # bits are counted from 1
    found = df.filter("source_index >= 0").groupBy(*keys, F.bitmap_bucket_number(at).alias("bucket"))
    return found.agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def _bit(bits: str, place: str) -> str:
    byte = f"CAST(conv(hex(substring({bits}, CAST({place} div 8 AS INT) + 1, 1)), 16, 10) AS BIGINT)"
    return f"shiftright({byte}, CAST({place} % 8 AS INT)) & 1"


def missing_documents(docs: DataFrame, kb: DataFrame) -> DataFrame:
    """Documents without a row in the knowledge base, wherever the gap is: their
    bit is looked up in its bitmaps, so none of its rows is shuffled."""
    held = positions(kb).select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    held = F.broadcast(held) if has_at_most(held, BROADCAST_BUCKETS) else held
    found = docs.join(held, F.bitmap_bucket_number(F.col("source_index") + 1) == F.col("_bucket"), "left")
    place = f"pmod(source_index, {BUCKET})"
    gone = F.expr(f"source_index < 0 OR source_index IS NULL OR _bits IS NULL OR {_bit('_bits', place)} = 0")
    return found.filter(gone).select(*docs.columns)


def common_prefix(kb: DataFrame, variants: Sequence[tuple[str, str]]) -> DataFrame:
    """One row: the last `source_index` up to which no variant has a gap, -1
    without any. A bucket's bitmaps are cut with each other; of the first one
    that some variant has not filled, the lowest open bit is the answer."""
    wanted = F.array(*[F.struct(F.lit(m).alias("embedding_model"), F.lit(c).alias("chunking")) for m, c in variants])
    asked = kb.sparkSession.range(1).select(F.inline(wanted))
    each = positions(kb, "embedding_model", "chunking").join(F.broadcast(asked), ["embedding_model", "chunking"])
    both = each.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    full = both.filter((F.col("n") == len(set(variants))) & (F.bitmap_count("bits") == BUCKET)).select("bucket")
    # full buckets before the first that is not: their numbers have no gap
    after = full.select((F.col("bucket") + 1).alias("bucket")).unionByName(
        kb.sparkSession.range(1).select(F.lit(1).cast("long").alias("bucket"))
    )
    first = after.join(full, "bucket", "left_anti").agg(F.min("bucket").alias("bucket"))
    open_ = first.join(both.filter(F.col("n") == len(set(variants))), "bucket", "left")
    places = f"sequence(0L, {BUCKET - 1}L)"
    lowest = f"coalesce(get(filter({places}, p -> {_bit('bits', 'p')} = 0), 0), {BUCKET})"
    return open_.selectExpr(
        f"(bucket - 1) * {BUCKET} + IF(bits IS NULL, 0, {lowest}) - 1 AS prefix"
    )
