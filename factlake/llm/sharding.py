"""Shards of bounded size by extendible hashing.

Rows have a 62-bit code: 31 bits of their key's hash, then 31 bits of their own
row's. The directory is indexed by code prefixes: one bucket with all rows at
depth 0; a bucket that is too large is split on the next bit, any other stays
as it is. What is left is a shard each.

Only sums per prefix are shuffled. They are added up once at a depth at which
buckets are well below the limit, and the splits are decided on these sums;
buckets that are still too large there go on, eight bits deeper at a time.
Keys with more rows than one shard holds (a hot key, null keys) are split by
the row's bits, after the key's. A single row above the limit is a shard.

Null text has 0 bytes. An empty table has no shards.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.operators.scale import lookup_join, materialize

KEY_BITS = ROW_BITS = 31
CODE_BITS = KEY_BITS + ROW_BITS
STEP = 8


def key_hash(key: Column) -> Column:
    """31 bits of the md5 of the key's text (null: empty)."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.shiftright(number, 32 - KEY_BITS)


def assign_shards(df: DataFrame, size: Column, limit: int, key: str = "doc_id") -> DataFrame:
    """All columns of `df`, written down once, with n_bytes (of `size`), shard
    (the code's prefix in binary digits, empty if nothing had to be split) and
    depth (its length). Columns of these names are replaced."""
    row = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << ROW_BITS))
    code = F.shiftleft(key_hash(F.col(key)), ROW_BITS).bitwiseOR(row)
    own = [c for c in df.columns if c not in ("n_bytes", "shard", "depth")]
    rows = df.select(
        F.struct(*own).alias("_row"), F.coalesce(size.cast("bigint"), F.lit(0)).alias("n_bytes"), code.alias("_code")
    )
    return _extend(materialize(rows, "shard-rows", "zstd"), limit).select("_row.*", "n_bytes", "depth", "shard")


def _extend(rows: DataFrame, limit: int) -> DataFrame:
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth, done = 0, 0
    if total > limit:
        depth = min(CODE_BITS, ceil(log2(total / limit)) + 3)
    found: DataFrame | None = None
    while True:
        prefixed = rows.withColumn("_prefix", F.shiftright("_code", CODE_BITS - depth))
        if found is not None:
            prefixed = prefixed.join(open_, F.shiftright("_prefix", depth - done) == open_["_open"], "left_semi")
        directory = materialize(_local_depths(prefixed, limit, done, depth), "directory")
        settled = directory.filter("_depth is not null")
        part = lookup_join(prefixed, settled, "_prefix", "_code").withColumn(
            "shard",
            F.when(F.col("_depth") == 0, "").otherwise(
                F.expr(f"lpad(bin(shiftright(_prefix, {depth} - _depth)), _depth, '0')")
            ),
        )
        part = part.withColumn("depth", F.col("_depth")).drop("_prefix", "_code", "_depth")
        found = part if found is None else found.unionByName(part)
        open_ = directory.filter("_depth is null").select(F.col("_prefix").alias("_open"))
        if open_.isEmpty():
            return found
        done, depth = depth, min(CODE_BITS, depth + STEP)


def _local_depths(prefixed: DataFrame, limit: int, first: int, last: int) -> DataFrame:
    """(_prefix, _depth): the lowest depth at which the prefix's bucket fits;
    null if it does not fit at depth `last`, unless that is the last bit."""
    leaves = prefixed.groupBy("_prefix").agg(
        F.sum("n_bytes").alias("_bytes"), F.count("*").alias("_rows")
    )
    leaves = materialize(leaves, "directory")
    depths = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("_d")
    spread = leaves.select("*", depths).withColumn(
        "_bucket", F.expr(f"shiftright(_prefix, {last} - _d)")
    )
    sums = spread.groupBy("_d", "_bucket").agg(
        F.sum("_bytes").alias("_bytes"), F.sum("_rows").alias("_rows")
    )
    fits = sums.filter(
        (F.col("_bytes") <= limit) | (F.col("_rows") == 1) | (F.col("_d") == CODE_BITS)
    )
    local = (
        spread.select("_prefix", "_d", "_bucket")
        .join(fits.select("_d", "_bucket"), ["_d", "_bucket"])
        .groupBy("_prefix")
        .agg(F.min("_d").alias("_depth"))
    )
    return leaves.select("_prefix").join(local, "_prefix", "left")


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard, `shard=s` and its digits (a reader would take
    digits alone for a number); a shard's rows are written by one task."""
    named = assigned.withColumn("shard", F.concat(F.lit("s"), "shard"))
    named.repartition("shard").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, size: Column, limit: int) -> DataFrame:
    """What stands in the files: all rows with shard, depth and n_bytes (of
    `size`). Raises if a shard of several rows is above the limit."""
    rows = spark.read.parquet(path).withColumns(
        {
            "n_bytes": F.coalesce(size.cast("bigint"), F.lit(0)),
            "depth": F.length("shard") - 1,
            "shard": F.expr("substring(shard, 2)"),
        }
    )
    sums = rows.groupBy("shard").agg(F.sum("n_bytes").alias("n"), F.count("*").alias("rows"))
    if not sums.filter((F.col("n") > limit) & (F.col("rows") > 1)).isEmpty():
        raise ValueError(f"a shard in {path} is above {limit} bytes")
    return rows


def shards_sql(limit: int, deepest: int = 20) -> str:
    """The same directory in SQL, for keys whose rows fit a shard."""
    return f"""
    WITH rows AS (
      SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
        (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT >> 1) AS code
      FROM documents),
    depths AS (SELECT CAST(range AS INTEGER) AS depth FROM range({deepest + 1})),
    spread AS (SELECT rows.*, depth, code >> (31 - depth) AS bucket FROM rows, depths),
    fits AS (
      SELECT depth, bucket FROM spread GROUP BY depth, bucket
      HAVING sum(n_bytes) <= {limit} OR count(*) = 1),
    chosen AS (
      SELECT doc_id, n_bytes, code, min(depth) AS depth
      FROM spread JOIN fits USING (depth, bucket) GROUP BY doc_id, n_bytes, code)
    SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, depth,
      CASE WHEN depth = 0 THEN '' ELSE lpad(bin(code >> (31 - depth)), depth, '0') END AS shard
    FROM chosen"""
