"""Building blocks that keep every other operator free of single-task work,
unbounded broadcasts and hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_SPLIT = 1_000_000
# Largest side that may be broadcast: rows are counted first.
MAX_BROADCAST_ROWS = 100_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder. A local
    session without that setting gets a temporary one; a cluster session
    without it is refused, since its executors share no local disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="factlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage and
    survives the loss of an executor. `codec` is that of the files, if not the
    session's: whole copies of a table take less disk with zstd."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows hashed by `key` over all cores when the input has fewer splits than
    that (a single small file); an input with enough splits is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def deal(df: DataFrame, key: str) -> DataFrame:
    """Rows hashed by `key` over as many partitions as there are cores or a
    shuffle has, whichever is more. Before few bytes that are costly to work on
    are written down: after a join they are put together into one or two files,
    which as many tasks read."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, spark.sparkContext.defaultParallelism), key)


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Counts no further than `rows` + 1."""
    return df.limit(rows + 1).count() <= rows


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    spread_by: str,
    rows_per_split: int | None = None,
) -> DataFrame:
    """Inner join of `left` (any key may be hot) with `right` (unique keys).

    Key counts come from a pre-aggregated pass. A key with more rows than
    `rows_per_split` is cut into that many pieces, and only its `right` row is
    repeated; the table of such keys has at most rows / rows_per_split rows.
    """
    rows_per_split = rows_per_split or ROWS_PER_SPLIT
    hot = (
        left.groupBy(on)
        .count()
        .filter(F.col("count") > rows_per_split)
        .select(on, F.ceil(F.col("count") / rows_per_split).cast("int").alias("_n"))
    )
    piece = F.pmod(F.xxhash64(spread_by), F.coalesce("_n", F.lit(1))).cast("int")
    spread = left.join(F.broadcast(hot), on, "left").withColumn("_piece", piece).drop("_n")
    pieces = F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)
    repeated = (
        right.join(F.broadcast(hot), on, "left")
        .withColumn("_piece", F.explode(pieces))
        .drop("_n")
    )
    return spread.join(repeated, [on, "_piece"]).drop("_piece")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    spread_by: str,
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Inner join with a table of unique keys: broadcast when its counted size
    allows, else shuffled with hot keys split."""
    if has_at_most(right, max_rows):
        return left.join(F.broadcast(right), on)
    return skew_join(left, right, on, spread_by)


def top_n_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str = "rank",
    spread_by: str | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """First `n` rows of each group, numbered from 1. With `spread_by`, a group
    is first cut to `n` rows in each of `pieces` parts (default: as many as a
    shuffle has partitions), so no task has to sort a whole hot group."""
    if spread_by is not None:
        pieces = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.withColumn("_piece", F.pmod(F.xxhash64(spread_by), F.lit(pieces)))
        part = Window.partitionBy(*keys, "_piece").orderBy(*order)
        df = df.withColumn("_rn", F.row_number().over(part)).filter(F.col("_rn") <= n)
        df = df.drop("_piece", "_rn")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= n)


def hash_order(seed: int, key: str) -> Column:
    """The pseudo-random sort key of a row: depends on seed and id only."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def hash_share(key: str, seed: int) -> Column:
    """The first 60 bits of `hash_order` as a share of all hashes, in [0, 1)."""
    digits = F.substring(hash_order(seed, key), 1, 15)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 60))


def dense_index(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """0-based position in a total order, without sorting in one task: rows are
    sorted into ranges, written down with their place in the range, and shifted
    by the rows of the ranges before (a table of one row per range)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    position = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_range", part)
        .join(F.broadcast(starts), "_range")
        .withColumn(name, position.cast("long"))
        .drop("_range", "_start", "_at")
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    totals: dict[str, Column],
    block: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Running sums up to and including each row, per key, along a dense
    `position`. Sums of whole blocks are added up first, so a window never
    holds more than one block of rows of one key."""
    df = df.withColumn("_block", F.floor(F.col(position) / block))
    group = [*keys, "_block"]
    sums = df.groupBy(*group).agg(*[F.sum(c).alias(f"_{n}") for n, c in totals.items()])
    earlier = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sums.select(
        *group,
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in totals],
    )
    inside = (
        Window.partitionBy(*group).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    )
    out = df.join(starts, group)
    for n, c in totals.items():
        out = out.withColumn(n, F.col(f"_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_block", *[f"_{n}" for n in totals])
