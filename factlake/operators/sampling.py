"""Row positions, batches, seeded shuffles and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.operators.scale import (
    dense_index,
    hash_order,
    hash_share,
    top_n_per_group,
)


def with_source_index(df: DataFrame, key: str, name: str = "source_index") -> DataFrame:
    """0-based position in the order of a unique key."""
    return dense_index(df, [F.col(key)], name)


def with_batch(df: DataFrame, size: int = 128) -> DataFrame:
    return df.withColumn("batch", F.floor(F.col("source_index") / size))


def shuffle_rows(df: DataFrame, key: str, seed: int = 42, ordered: bool = True) -> DataFrame:
    """Rows with their `position` in a seeded random order, in that order
    unless `ordered` is False: then the rows are not sorted a second time."""
    hashed = df.withColumn("_hash", hash_order(seed, key))
    placed = dense_index(hashed, [F.col("_hash"), F.col(key)], "position").drop("_hash")
    return placed.orderBy("position") if ordered else placed


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Simple random sample of `n` rows: the first ones in hash order. Rows
    above a share of the hashes that holds a little more than `n` of all rows
    are left out before anything is sorted."""
    rows = df.count()
    share = (n + 6 * n**0.5 + 20) / max(rows, 1)
    order = [hash_order(seed, key), F.col(key)]
    if share >= 1:
        return df.orderBy(*order).limit(n)
    few = df.filter(hash_share(key, seed) < share)
    # Less than once in 10^8 samples the share holds too few.
    return (few if few.count() >= n else df).orderBy(*order).limit(n)


def sample_class(df: DataFrame, label: int, n: int, key: str, seed: int = 42) -> DataFrame:
    """Random sample of `n` rows of one class; fails when it has fewer."""
    taken = sample_n(df.filter(F.col("label") == label), n, key, seed)
    short = F.raise_error(F.lit(f"class {label} has fewer than {n} rows"))
    size = taken.agg(F.when(F.count("*") < n, short.cast("boolean")).otherwise(True).alias("_ok"))
    return taken.withColumn("_ok", size.scalar()).filter("_ok").drop("_ok")


def balanced_sample(
    df: DataFrame, n: int, key: str, seed: int = 42, labels: tuple[int, ...] = (0, 1)
) -> DataFrame:
    """`n` rows of each class, in seeded order by `position`."""
    parts = [sample_class(df, label, n, key, seed) for label in labels]
    return shuffle_rows(reduce(DataFrame.unionByName, parts), key, seed)


def class_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Up to `n` rows of every class in one pass over the data."""
    order = [hash_order(seed, key), F.col(key)]
    return top_n_per_group(df, ["label"], order, n, "draw", spread_by=key)
