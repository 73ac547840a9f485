"""Batch calls to user-supplied models, and the built-in vote of neighbours."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.functions.verdict import encode_verdict, parse_verdict
from factlake.operators.scale import MAX_BROADCAST_ROWS, has_at_most, lookup_join, materialize
from factlake.operators.similarity import MAX_MATRIX_BYTES

Encoder = Callable[[list[str]], Sequence[Sequence[float]]]
# A request to its answer: JSON text, or that and what the model thought.
Scorer = Callable[[dict], str | tuple[str, str | None]]


def embed_variants(
    df: DataFrame,
    encoders: Mapping[str, Encoder],
    batch_size: int = 128,
    column: str = "content",
    model: str = "embedding_model",
) -> DataFrame:
    """Adds `embedding`, made by the encoder that the `model` column names. An
    encoder is called with up to `batch_size` texts."""
    field = T.StructField("embedding", T.ArrayType(T.FloatType()))
    schema = T.StructType([f for f in df.schema if f.name != "embedding"] + [field])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, rows in frame.groupby(model, sort=False, dropna=False):
                for at in range(0, len(rows), batch_size):
                    part = rows.iloc[at : at + batch_size]
                    yield part.assign(embedding=list(encoders[name](part[column].tolist())))

    return df.drop("embedding").mapInPandas(run, schema)


def embed(df: DataFrame, encoder: Encoder, batch_size: int = 128, column: str = "content") -> DataFrame:
    """The same with one encoder for all rows."""
    only = df.withColumn("_model", F.lit("only"))
    return embed_variants(only, {"only": encoder}, batch_size, column, "_model").drop("_model")


# Rows whose requests are in memory at the same time.
SCORED_TOGETHER = 256
ANSWER = [
    T.StructField("raw", T.StringType()),
    T.StructField("thought", T.StringType()),
    T.StructField("latency_sec", T.DoubleType()),
    T.StructField("elapsed_sec", T.DoubleType()),
    T.StructField("call_error", T.StringType()),
]


def score(
    df: DataFrame,
    scorer: Scorer,
    clock: Callable[[], float] = time.perf_counter,
    request: Sequence[str] | None = None,
    concurrency: int = 4,
) -> DataFrame:
    """Adds `raw` (the model's JSON text), `thought`, `latency_sec` (of the
    call), `elapsed_sec` (since the batch was asked for) and `call_error`. The
    scorer gets the columns `request` (default: all) as a dict, and up to
    `concurrency` calls of a task wait at the same time. A call that raises is
    reported in its row; the others go on. Only the requests of a few hundred
    rows are Python objects at a time; all else stays in its Arrow batch."""
    names = list(request or df.columns)
    started = time.time()

    def call(row: dict) -> tuple:
        start = clock()
        try:
            answer = scorer(row)
            raw, thought = answer if isinstance(answer, tuple) else (answer, None)
        except Exception as e:  # reported per row, as one failed call must not end the job
            return None, None, None, time.time() - started, f"{type(e).__name__}: {e}"
        return raw, thought, clock() - start, time.time() - started, None

    kinds = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, SCORED_TOGETHER):
                    part = batch.slice(at, SCORED_TOGETHER)
                    calls = list(pool.map(call, part.select(names).to_pylist()))
                    answers = [pa.array(a, kind) for a, kind in zip(zip(*calls), kinds)]
                    columns = dict(zip(part.schema.names, part.columns))
                    columns |= {f.name: a for f, a in zip(ANSWER, answers)}
                    yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, T.StructType([*df.schema, *ANSWER]))


def parse_scores(scored: DataFrame) -> DataFrame:
    """Verdict columns of scored rows; a failed call is an invalid row."""
    v = F.col("_v")
    return (
        scored.withColumn("_v", parse_verdict(F.col("raw")))
        .select(
            *scored.columns,
            v["label"].alias("verdict"),
            v["confidence"].alias("confidence"),
            v["reasoning"].alias("reasoning"),
            (v["is_valid"] & F.col("call_error").isNull()).alias("is_valid"),
            F.coalesce("call_error", v["error"]).alias("error"),
        )
        .drop("call_error")
    )


def collect_neighbours(neighbours: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """One row per query with `docs`, its at most k neighbours in rank order."""
    fields = [c for c in neighbours.columns if c not in keys and c != "rank"]
    docs = F.array_sort(F.collect_list(F.struct("rank", *fields)))
    return neighbours.groupBy(*keys).agg(docs.alias("docs"))


def vote(docs: Column, max_distance: float = 1.0) -> Column:
    """Verdict struct from neighbours (label, distance): each within
    `max_distance` weighs 1 - distance; fake unless real weighs more."""

    def weight(label: int) -> Column:
        near = F.filter(
            docs, lambda d: (d["label"] == label) & (d["distance"] <= max_distance)
        )
        return F.aggregate(near, F.lit(0.0), lambda s, d: s + (1.0 - d["distance"]))

    fake, real = weight(0), weight(1)
    total = fake + real
    share = F.round(F.coalesce(F.try_divide(F.greatest(fake, real), total), F.lit(0.0)), 6)
    return F.struct(
        F.when(real > fake, "real").otherwise("fake").alias("label"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("confidence"),
        F.when(total > 0, "weighted vote of the neighbours")
        .otherwise("no neighbour is near enough")
        .alias("reasoning"),
    )


def vote_verdict(neighbours: DataFrame, max_distance: float = 1.0) -> DataFrame:
    """query_id, label, confidence, reasoning; stands in for a model."""
    voted = collect_neighbours(neighbours).select(
        "query_id", vote(F.col("docs"), max_distance).alias("v")
    )
    return voted.select("query_id", "v.*")


def known_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """One vector of `dim` doubles per word. NULL words and vectors are left
    out, a NULL number counts as 0, of several vectors of a word the smallest
    (number by number) counts, and another length is an error."""
    number = F.transform(
        F.col("vector").cast("array<double>"), lambda x: F.coalesce(x, F.lit(0.0))
    )
    wrong = F.raise_error(F.lit(f"every word vector must have {dim} numbers"))
    checked = F.when(F.size("vector") == dim, number).otherwise(wrong.cast("array<double>"))
    usable = vectors.filter(F.col("word").isNotNull() & F.col("vector").isNotNull())
    return usable.select("word", checked.alias("vector")).groupBy("word").agg(F.min("vector").alias("vector"))


def embed_mean(
    docs: DataFrame,
    vectors: DataFrame,
    dim: int,
    key: str = "doc_id",
    max_bytes: int = MAX_MATRIX_BYTES,
    common: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Mean word vector per document from (key, `words` array); words without a
    vector count as zeros. The vectors are `known_vectors`."""
    vectors = materialize(known_vectors(vectors, dim), "word-vectors")
    sums = word_sums(docs, vectors, dim, key, max_bytes, common)
    return sums.select(key, F.transform("sum", lambda x: x / F.greatest("n", F.lit(1))).alias("vector"))


def word_sums(
    docs: DataFrame,
    vectors: DataFrame,
    dim: int,
    key: str = "doc_id",
    max_bytes: int = MAX_MATRIX_BYTES,
    common: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """key, n and sum for every row of (key, `words` array): how many words it
    has, and their vectors added up, from (word, vector) with unique words.
    Words without a vector add nothing. A vector table of at most `max_bytes`
    (it is counted) is broadcast, and no row leaves its place; of a larger one
    the `common` words that most documents hold are broadcast, all others
    joined."""
    if has_at_most(vectors, max_bytes // (8 * dim)):
        found = docs.select(key, F.size("words").alias("n"), _pool(vectors, dim)(F.col("words")).alias("found"))
        return found.select(key, "n", "found.sum")
    return _joined_sums(docs, vectors, dim, key, min(common, MAX_MATRIX_BYTES // (8 * dim)))


def _pool(vectors: DataFrame, dim: int, rest: bool = False) -> Callable[[Column], Column]:
    """Column function: sum of the vectors of an array of words and, with
    `rest`, the words that are not in the table."""
    table = vectors.select("word", F.col("vector").cast("array<double>")).toArrow()
    numbers = np.asarray(table["vector"].combine_chunks().flatten()).reshape(-1, dim)
    known_words = table["word"].combine_chunks()
    shared = vectors.sparkSession.sparkContext.broadcast((known_words, numbers))

    @F.arrow_udf("sum array<double>, rest array<string>")
    def pool(lists: pa.Array) -> pa.Array:
        known_words, numbers = shared.value
        lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
        flat = lists.flatten()
        found = pc.index_in(flat, value_set=known_words)
        every = np.repeat(np.arange(len(lists)), lengths)
        row = every[np.asarray(found.is_valid())]
        at = np.asarray(found.drop_null())
        sums = np.empty((len(lists), dim))
        for j in range(dim):
            sums[:, j] = np.bincount(row, numbers[at, j], minlength=len(lists))
        ends = np.arange(len(lists) + 1, dtype=np.int32) * dim
        total = pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel()))
        others = np.asarray(pc.and_(found.is_null(), flat.is_valid())) & rest
        ends = np.append(0, np.cumsum(np.bincount(every[others], minlength=len(lists)))).astype(np.int32)
        words = flat.filter(pa.array(others)).cast(pa.string())
        return pa.StructArray.from_arrays([total, pa.ListArray.from_arrays(pa.array(ends), words)], names=["sum", "rest"])

    return pool


def _joined_sums(docs: DataFrame, vectors: DataFrame, dim: int, key: str, common: int) -> DataFrame:
    """Most words of a text are common ones and are summed up in its row; only
    the others are joined, and only a vector of them and one sum per document
    are shuffled. What is read more than once is written down first."""
    docs = materialize(docs.select(key, "words").withColumn("_row", F.monotonically_increasing_id()), "word-lists")
    often = docs.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count()
    often = often.orderBy(F.desc("count"), "word").limit(common).select("word")
    often = materialize(vectors.join(F.broadcast(often), "word"), "common-words")
    pooled = docs.select(key, "_row", F.size("words").alias("n"), _pool(often, dim, True)(F.col("words")).alias("p"))
    pooled = materialize(pooled.select(key, "_row", "n", F.col("p.sum").alias("_sum"), "p.rest"), "pooled")
    others = pooled.select("_row", F.explode("rest").alias("word"))
    known = lookup_join(others, vectors, "word", spread_by="_row")
    # Plain sums: those of whole numbers are exact
    added = F.array(*[F.sum(F.get("vector", F.lit(i))) for i in range(dim)])
    sums = known.groupBy("_row").agg(added.alias("_rare"))
    both = F.zip_with("_sum", "_rare", lambda a, b: a + b)
    total = F.coalesce(both, "_sum").alias("sum")
    return pooled.select(key, "_row", "n", "_sum").join(sums, "_row", "left").select(key, "n", total)


def outcomes(truth: DataFrame, predictions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Truth beside prediction; `y_pred` is NULL without a valid verdict."""
    predicted = F.when(F.col("is_valid"), encode_verdict(F.col("verdict")))
    return predictions.withColumn("y_pred", predicted).join(
        truth.select(key, F.col("label").alias("y_true")), key
    )


def align(truth: DataFrame, predictions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Truth beside prediction; rows without a valid verdict are left out."""
    return outcomes(truth, predictions, key).filter("y_pred is not null")
