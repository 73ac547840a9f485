"""Linguistic features: vocabulary, TF-IDF, emotions, and their assembly."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.functions.text import head_chars, tally, terms, words
from factlake.operators.scale import lookup_join, materialize
from factlake.operators.scoring import word_sums

# Cuts of the vocabulary, the emotions in feature order, and the
# sizes of the reduced blocks.
MIN_DF = 2
MAX_DF = 0.95
MAX_TERMS = 10_000
EMOTIONS = [
    "fear",
    "anger",
    "anticipation",
    "trust",
    "surprise",
    "sadness",
    "disgust",
    "joy",
]
TFIDF_DIMS = 20
EMBEDDING_DIMS = 20
FEATURE_NAMES = (
    [f"tfidf_{i}" for i in range(TFIDF_DIMS)]
    + [f"emb_{i}" for i in range(EMBEDDING_DIMS)]
    + EMOTIONS
)


ENTRIES = T.ArrayType(
    T.StructType([T.StructField("at", T.IntegerType()), T.StructField("weight", T.DoubleType())])
)


def term_counts(docs: DataFrame, key: str = "doc_id", column: str = "content") -> DataFrame:
    """key, term, tf: how often each term occurs in each document. The terms of
    a document are counted in its row, so nothing is shuffled by document."""
    counted = docs.select(key, F.explode(tally(terms(F.col(column)))).alias("t"))
    return counted.select(
        key, F.col("t.item").alias("term"), F.col("t.n").cast("long").alias("tf")
    )


def vocabulary(
    docs: DataFrame,
    key: str = "doc_id",
    column: str = "content",
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    counts: DataFrame | None = None,
) -> DataFrame:
    """term, total, df and n_docs of the terms in at least `min_df` documents
    and in at most the share `max_df` of them. Without `counts`, all terms and
    the distinct ones of each document are counted in one pass, with no counts
    by document."""
    if counts is None:
        found = docs.select(terms(F.col(column)).alias("_all"))
        parts = found.select(F.posexplode(F.array("_all", F.array_distinct("_all"))).alias("_part", "_terms"))
        single = parts.select("_part", F.explode("_terms").alias("term"))
        per_term = single.groupBy("term").agg(
            F.count_if(F.col("_part") == 0).alias("total"), F.count_if(F.col("_part") == 1).alias("df")
        )
    else:
        per_term = counts.groupBy("term").agg(
            F.sum("tf").alias("total"), F.count("*").alias("df")
        )
    n_docs = docs.agg(F.count("*").alias("n")).scalar()
    return per_term.withColumn("n_docs", n_docs).filter(
        (F.col("df") >= min_df) & (F.col("df") <= F.col("n_docs") * max_df)
    )


def top_terms(vocab: DataFrame, n: int = MAX_TERMS) -> DataFrame:
    """The `n` terms with the largest totals, ties by term."""
    return vocab.orderBy(F.desc("total"), "term").limit(n)


def with_idf(vocab: DataFrame) -> DataFrame:
    """Smoothed inverse document frequency: ln((1 + n) / (1 + df)) + 1."""
    return vocab.withColumn("idf", F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1)


def tfidf_long(
    docs: DataFrame, vocab: DataFrame, key: str = "doc_id", column: str = "content"
) -> DataFrame:
    """key, term, weight: L2-normalised TF-IDF in long form. With a vocabulary
    no larger than the cut makes it, a document is weighed and normalised in its
    row; a larger one is joined, and lengths are summed by document."""
    known = with_idf(vocab).select("term", "idf").limit(MAX_TERMS + 1).collect()
    if not known:
        return docs.selectExpr(key, "CAST(NULL AS STRING) AS term", "CAST(NULL AS DOUBLE) AS weight").limit(0)
    if len(known) <= MAX_TERMS:
        model = TfidfModel(*map(list, zip(*known)))
        entries = F.inline(_entries(F.col("_v")))
        weighed = model.transform(docs.select(key, column), column, "_v").select(key, entries)
        names = docs.sparkSession.createDataFrame(list(enumerate(model.terms)), "at int, term string")
        return weighed.join(F.broadcast(names), "at").select(key, "term", "weight")
    weighted = lookup_join(
        term_counts(docs, key, column), with_idf(vocab).select("term", "idf"), "term", key
    ).withColumn("w", F.col("tf") * F.col("idf"))
    of_document = Window.partitionBy(key)
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(of_document))
    return weighted.select(key, "term", (F.col("w") / length).alias("weight"))


@F.arrow_udf(ENTRIES)
def _entries(vectors: pa.Array) -> pa.Array:
    """Places and values of sparse vectors."""
    at, weight = vectors.field("indices"), vectors.field("values")
    flat = pa.StructArray.from_arrays([at.flatten(), weight.flatten()], names=["at", "weight"])
    sizes = np.asarray(pc.fill_null(pc.list_value_length(at), 0), np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), flat)


@dataclass(frozen=True)
class TfidfModel:
    """Fitted vocabulary (at most the cut's size) with idf weights."""

    terms: list[str]
    idf: list[float]

    def transform(self, docs: DataFrame, column: str = "content", output: str = "tfidf") -> DataFrame:
        """Adds a sparse vector column, row by row, without a shuffle."""
        count = CountVectorizerModel.from_vocabulary(self.terms, "_terms", "_tf", minTF=1.0)
        scale = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_w"
        )
        unit = Normalizer(p=2.0, inputCol="_w", outputCol=output)
        out = docs.withColumn("_terms", terms(F.col(column)))
        for step in (count, scale, unit):
            out = step.transform(out)
        return out.drop("_terms", "_tf", "_w")


def fit_tfidf(
    docs: DataFrame,
    key: str = "doc_id",
    column: str = "content",
    max_terms: int = MAX_TERMS,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
) -> TfidfModel:
    chosen = with_idf(top_terms(vocabulary(docs, key, column, min_df, max_df), max_terms))
    rows = chosen.select("term", "idf").collect()
    if not rows:
        raise ValueError("no term passes the vocabulary cuts")
    return TfidfModel([r["term"] for r in rows], [r["idf"] for r in rows])


def emotion_lexicon(lexicon: DataFrame) -> DataFrame:
    """(word, affect) rows as one row per word: a 0/1 count per emotion and the
    number of all its affects, the positive and negative ones included."""
    marks = [F.count_if(F.col("affect") == e).alias(e) for e in EMOTIONS]
    return lexicon.groupBy("word").agg(*marks, F.count("*").alias("affects"))


def lexicon_join(tokens: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens (key, word) with the emotion counts of their word."""
    return lookup_join(tokens, emotion_lexicon(lexicon), "word", spread_by=key)


def emotion_scores(
    docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", column: str = "content", chars: int = 1000
) -> DataFrame:
    """key and one score per emotion: its share of all affects found in the
    first `chars` characters, 0 when there is none. Every row is a document.
    Affects are added up as word vectors are, so only words that are not common
    leave their row."""
    head = docs.select(key, words(head_chars(F.col(column), chars)).alias("words"))
    counts = F.array(*EMOTIONS, "affects").cast("array<double>")
    affects = emotion_lexicon(lexicon.filter("word is not null")).select("word", counts.alias("vector"))
    sums = word_sums(head, materialize(affects, "affects"), len(EMOTIONS) + 1, key)
    total = F.get("sum", F.lit(len(EMOTIONS)))
    scores = [
        F.coalesce(F.try_divide(F.get("sum", F.lit(i)), total), F.lit(0.0)).alias(e)
        for i, e in enumerate(EMOTIONS)
    ]
    return sums.select(key, *scores)


def assemble_features(
    tfidf: DataFrame, embedding: DataFrame, emotions: DataFrame, key: str = "doc_id"
) -> DataFrame:
    """One 48-number vector per document from (key, tfidf), (key, emb) arrays of
    20 numbers and the emotion columns."""
    joined = tfidf.join(embedding, key).join(emotions, key)
    blocks = joined.withColumns(
        {"_tfidf": array_to_vector("tfidf"), "_emb": array_to_vector("emb")}
    )
    columns = ["_tfidf", "_emb", *EMOTIONS]
    out = VectorAssembler(inputCols=columns, outputCol="features").transform(blocks)
    return out.drop("tfidf", "emb", *columns)
