"""The knowledge base on disk: one table, partitioned by model and chunking.

A batch (or a snapshot) is one folder that counts only once its write has
finished, so a job that dies half-way leaves nothing behind to be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions.prompt import snapshot_id
from factlake.schemas import KB
from factlake.sources.files import committed_folders
from factlake.sources.versions import current_state, read_state, state_of

VARIANT = ["embedding_model", "chunking"]
CHUNK_BITS = 20


def empty_kb(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], KB)


def write_kb(df: DataFrame, path: str, batch: str) -> None:
    """Writes the rows of one batch; writing it again replaces it."""
    rows = df.select(*[F.col(f.name).cast(f.dataType) for f in KB])
    target = f"{path}/batch={batch}"
    rows.write.mode("overwrite").partitionBy(*VARIANT).parquet(target)


def _read_folders(spark: SparkSession, folders: dict[str, str], root: str) -> DataFrame:
    if not folders:
        return empty_kb(spark)
    reader = spark.read.schema(KB).option("basePath", root)
    return reader.parquet(*folders.values()).select(*KB.names)


def read_kb(
    spark: SparkSession,
    path: str,
    model: str | None = None,
    chunking: str | None = None,
    version: str | None = None,
) -> DataFrame:
    """The current state, or that of a version; the filters prune folders."""
    state = current_state(spark, path) if version is None else state_of(spark, path, version)
    kb = read_state(spark, path, state, KB)
    kb = empty_kb(spark) if kb is None else kb
    if model is not None:
        kb = kb.where(F.col("embedding_model") == model)
    if chunking is not None:
        kb = kb.where(F.col("chunking") == chunking)
    return kb


def read_batch(spark: SparkSession, path: str, batch: str) -> DataFrame:
    """The rows of one finished batch."""
    return _read_folders(spark, {batch: f"{path}/batch={batch}"}, path)


def with_vec_id(kb: DataFrame) -> DataFrame:
    """Adds the id that the search needs, unique within one model and chunking.
    A document with 2^20 chunks or more is an error, as its ids would run into
    the next document's."""
    many = F.raise_error(F.lit(f"a document has more than {1 << CHUNK_BITS} chunks")).cast("long")
    vec_id = F.shiftleft("source_index", CHUNK_BITS) + F.col("chunk_no")
    fits = F.col("chunk_no") < (1 << CHUNK_BITS)
    return kb.withColumn("vec_id", F.when(fits, vec_id).otherwise(many))


def snapshot_kb(kb: DataFrame, root: str, snapshot: str | None = None) -> str:
    """Copies the knowledge base to a timestamped folder."""
    name = snapshot or kb.sparkSession.range(1).select(snapshot_id()).first()[0]
    target = f"{root}/snapshot={name}"
    kb.select(*KB.names).write.mode("overwrite").partitionBy(*VARIANT).parquet(target)
    return name


def restore_kb(spark: SparkSession, root: str) -> DataFrame:
    """The newest finished snapshot, or an empty knowledge base."""
    found = committed_folders(spark, root, "snapshot")
    newest = dict([max(found.items())]) if found else {}
    return _read_folders(spark, newest, root)
