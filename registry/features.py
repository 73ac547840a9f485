"""Linguistic features and the baseline."""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.functions.encoders import hashing_encoder
from factlake.functions.text import clean_text, head_chars, words
from factlake.functions.verdict import encode_verdict
from factlake.operators import features as ft
from factlake.operators.forest import feature_importances
from factlake.operators.pca import fit_pca
from factlake.operators.scale import materialize
from factlake.operators.scoring import embed_mean
from factlake.plans import baseline
from factlake.plans.compare import compare_on_sample
from factlake.settings import Settings
from factlake.sources.tables import render_na
from registry.news import DOCUMENT, clean_sql
from registry.verification import hash_vectors_sql
from registry.tables import (
    NEWS,
    VECTOR_DIM,
    distance_sql,
    lexicon,
    lexicon_sql,
    news,
    table,
    vote_sql,
    with_,
    word_vectors,
    word_vectors_sql,
)

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Every document, cleaned; the vocabulary of all of them.
DOCS = f"""docs AS MATERIALIZED (SELECT doc_id, {clean_sql('text')} AS content FROM documents),
tf AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(content, '\\b\\w\\w+\\b')) AS term FROM docs)
  GROUP BY doc_id, term),
vocab AS MATERIALIZED (
  SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df, (SELECT count(*) FROM docs) AS n_docs
  FROM tf GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= (SELECT count(*) FROM docs) * CAST(0.95 AS DOUBLE))"""


def _docs(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", clean_text(F.col("text")).alias("content")
    )


@query(with_(DOCS) + "SELECT term, total, df, n_docs FROM vocab")
def vocabulary(spark, sf):
    return ft.vocabulary(_docs(spark, sf))


@query(with_(DOCS) + "SELECT term, total, df, n_docs FROM vocab ORDER BY total DESC, term LIMIT 10000")
def top_terms(spark, sf):
    return ft.top_terms(ft.vocabulary(_docs(spark, sf)))


TOP = "top AS (SELECT *, ln((1 + n_docs) / (1 + df)) + 1 AS idf FROM vocab ORDER BY total DESC, term LIMIT 10000)"


@query(
    with_(DOCS, TOP)
    + """SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
FROM (SELECT doc_id, term, tf * idf AS w FROM tf JOIN top USING (term))"""
)
def tfidf_weights(spark, sf):
    docs = _docs(spark, sf)
    vocab = ft.top_terms(ft.vocabulary(docs))
    out = ft.tfidf_long(docs, vocab)
    return out.withColumn("weight", F.round("weight", 6))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _entries(vectors: pa.Array) -> pa.Array:
    """The stored entries of sparse vectors."""
    return vectors.field("values")


@query(
    with_(DOCS, TOP)
    + """SELECT doc_id, count(w) AS n_terms, round(max(w / length), 6) AS largest
FROM docs LEFT JOIN (
  SELECT doc_id, w, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS length
  FROM (SELECT doc_id, term, tf * idf AS w FROM tf JOIN top USING (term))) USING (doc_id)
GROUP BY doc_id"""
)
def tfidf_vectors(spark, sf):
    """The vector form of the same weights, summed up per document."""
    docs = materialize(_docs(spark, sf), "cleaned")
    out = ft.fit_tfidf(docs).transform(docs)
    return out.select("doc_id", _entries("tfidf").alias("w")).select(
        "doc_id",
        F.size("w").cast("long").alias("n_terms"),
        F.round(F.array_max("w"), 6).alias("largest"),
    )


WORDS = "words AS (SELECT term AS word FROM vocab)"
HEAD = """heads AS (
  SELECT doc_id, list_filter(string_split(substr(content, 1, 1000), ' '), lambda w: w <> '') AS w FROM docs)"""


def _words(spark, sf):
    return _known(_docs(spark, sf))


def _known(docs):
    known = ft.vocabulary(docs).select(F.col("term").alias("word"))
    return materialize(known, "words")


def _heads(spark, sf):
    """The words of every document's first characters, and those of the
    vocabulary: texts are cleaned once."""
    docs = materialize(_docs(spark, sf), "cleaned")
    heads = docs.select("doc_id", words(head_chars(F.col("content"))).alias("words"))
    return heads, _known(docs)


@query(
    with_(DOCS, WORDS, HEAD, word_vectors_sql("words"))
    + f"""SELECT h.doc_id, CAST(i - 1 AS INTEGER) AS dim, round(coalesce(s.x / nullif(len(h.w), 0), 0), 6) AS value
FROM heads h CROSS JOIN (SELECT unnest(range(1, {VECTOR_DIM + 1})) AS i)
LEFT JOIN (
  SELECT doc_id, d AS i, sum(v.vector[d]) AS x
  FROM (SELECT doc_id, unnest(w) AS word FROM heads) t JOIN vectors v USING (word),
    (SELECT unnest(range(1, {VECTOR_DIM + 1})) AS d)
  GROUP BY 1, 2) s USING (doc_id, i)"""
)
def mean_word_vectors(spark, sf):
    docs, known = _heads(spark, sf)
    return _long_means(embed_mean(docs, word_vectors(known), VECTOR_DIM))


def _long_means(means):
    # Not posexplode: its inferred filter would be pushed down and work out
    # every vector a second time.
    long = means.select("doc_id", F.posexplode_outer("vector").alias("dim", "value"))
    return long.withColumn("value", F.round("value", 6))


@query(SQL["mean_word_vectors"])
def mean_word_vectors_joined(spark, sf):
    """The same as for a vector table that is too large to broadcast."""
    docs, known = _heads(spark, sf)
    return _long_means(embed_mean(docs, word_vectors(known), VECTOR_DIM, max_bytes=0))


GAPS_SQL = SQL["mean_word_vectors"].replace(
    "JOIN vectors v USING (word)", "JOIN (SELECT * FROM vectors WHERE length(word) % 3 <> 0) v USING (word)"
)


def _gappy(vectors):
    """A third of the words with a NULL vector, all others twice."""
    holed = vectors.withColumn("vector", F.when(F.length("word") % 3 != 0, F.col("vector")))
    return holed.unionByName(holed)


@query(GAPS_SQL)
def mean_word_vectors_gaps(spark, sf):
    """Words with NULL or repeated vectors, broadcast."""
    docs, known = _heads(spark, sf)
    return _long_means(embed_mean(docs, _gappy(word_vectors(known)), VECTOR_DIM))


@query(GAPS_SQL)
def mean_word_vectors_gaps_joined(spark, sf):
    docs, known = _heads(spark, sf)
    vectors = _gappy(word_vectors(known))
    return _long_means(embed_mean(docs, vectors, VECTOR_DIM, max_bytes=0))


@query(
    with_(DOCS, WORDS, lexicon_sql("words"))
    + """SELECT word, CAST(count(*) AS BIGINT) AS n_tokens, CAST(sum(affects) AS BIGINT) AS affects
FROM (SELECT doc_id, unnest(string_split(content, ' ')) AS word FROM docs) t
JOIN (SELECT word, count(*) AS affects FROM lexicon GROUP BY word) l USING (word) GROUP BY word"""
)
def lexicon_hits(spark, sf):
    """Every token of every document looked up, counted by word."""
    tokens = _docs(spark, sf).select("doc_id", F.explode(words(F.col("content"))).alias("word"))
    joined = ft.lexicon_join(tokens, lexicon(_words(spark, sf)))
    return joined.groupBy("word").agg(
        F.count("*").alias("n_tokens"), F.sum("affects").alias("affects")
    )


SCORES = ", ".join(
    f"round(coalesce(count(affect) FILTER (affect = '{e}') / nullif(count(affect), 0), 0), 6) AS {e}"
    for e in ft.EMOTIONS
)


@query(
    with_(DOCS, WORDS, HEAD, lexicon_sql("words"))
    + f"""SELECT doc_id, {SCORES}
FROM docs LEFT JOIN (SELECT doc_id, affect FROM (SELECT doc_id, unnest(w) AS word FROM heads)
  JOIN lexicon USING (word)) USING (doc_id) GROUP BY doc_id"""
)
def emotion_scores(spark, sf):
    scores = ft.emotion_scores(_docs(spark, sf), lexicon(_words(spark, sf)))
    return scores.withColumns({e: F.round(e, 6) for e in ft.EMOTIONS})


def _checked(df, model):
    """Of every component: its place, whether its scores have the variance that
    the model says, whether it is not above the one before."""
    said = [(i, float(v), float(model.variances[max(i - 1, 0)])) for i, v in enumerate(model.variances)]
    expected = df.sparkSession.createDataFrame(said, "component int, said double, before double")
    found = df.select(F.posexplode_outer("scores").alias("component", "x")).groupBy("component")
    found = found.agg(F.var_samp("x").alias("variance"), F.count("*").alias("n_rows"))
    near = F.abs(F.col("variance") - F.col("said")) <= 1e-6 * F.col("said") + 1e-9
    return found.join(F.broadcast(expected), "component").select(
        "component", "n_rows", near.alias("as_said"), (F.col("said") <= F.col("before")).alias("in_order")
    )


@query(
    """SELECT CAST(c AS INTEGER) AS component, (SELECT count(*) FROM documents) AS n_rows, true AS as_said, true AS in_order
FROM (SELECT unnest(range(0, 20)) AS c)"""
)
def tfidf_components(spark, sf):
    """Twenty components of the wide sparse weights, checked."""
    docs = materialize(_docs(spark, sf), "cleaned")
    vectors = materialize(ft.fit_tfidf(docs).transform(docs).select("doc_id", "tfidf"), "weights")
    model = fit_pca(vectors, "tfidf", ft.TFIDF_DIMS)
    return _checked(model.transform(vectors, "tfidf", "scores"), model)


COVARIANCE = f"""SELECT round(sum(CASE WHEN a.d = b.d THEN c END), 6) AS total, round(sum(c * c), 6) AS squares
FROM (
  SELECT a.d AS a_d, b.d AS b_d, covar_samp(a.value, b.value) AS c
  FROM means a JOIN means b USING (doc_id) GROUP BY 1, 2) x
JOIN (SELECT unnest(range(0, {VECTOR_DIM})) AS d) a ON a.d = x.a_d
JOIN (SELECT unnest(range(0, {VECTOR_DIM})) AS d) b ON b.d = x.b_d"""


@query(
    SQL["mean_word_vectors"].replace(
        "SELECT h.doc_id, CAST(i - 1 AS INTEGER) AS dim, round(coalesce(s.x / nullif(len(h.w), 0), 0), 6) AS value",
        ", means AS (SELECT h.doc_id, i - 1 AS d, coalesce(s.x / nullif(len(h.w), 0), 0) AS value",
    )
    + ")\n"
    + COVARIANCE
)
def vector_components(spark, sf):
    """All components of the mean word vectors: their variances add up to the
    covariance's trace, the squares to its squared norm."""
    docs, known = _heads(spark, sf)
    means = embed_mean(docs, word_vectors(known), VECTOR_DIM)
    dense = means.select(array_to_vector("vector").alias("v"))
    found = fit_pca(dense, "v", VECTOR_DIM).variances
    sums = [(round(float(found.sum()), 6), round(float((found**2).sum()), 6))]
    return spark.createDataFrame(sums, "total double, squares double")


def _lookups(docs):
    """Word vectors of 24 numbers and the lexicon, for the words of all news."""
    known = _known(docs)
    digits = [F.conv(F.substring(F.md5("word"), i, 1), 16, 10) / 15.0 - 0.5 for i in range(1, 25)]
    return known.select("word", F.array(*digits).alias("vector")), lexicon(known)


def _baseline(spark, sf):
    rows = news(spark, sf)
    vectors, affects = _lookups(baseline.cleaned(rows))
    train, test = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    return baseline.run_baseline(train, test, vectors, 24, affects)


TESTED = """SELECT label AS y FROM news WHERE split <> 'train'"""
NAMES = ", ".join(f"('{n}')" for n in ft.FEATURE_NAMES)


@query(
    with_(NEWS)
    + f"""SELECT (SELECT count(*) FROM ({TESTED})) AS n_scored, (SELECT count(*) FROM ({TESTED})) AS n_predicted,
  true AS recomputed, true AS above_majority, true AS timed"""
)
def baseline_metrics(spark, sf):
    """The forest on the test rows: all are scored, the metrics follow from the
    stored predictions, and it does no worse than always the commoner class,
    but for a margin of a twentieth."""
    run = _baseline(spark, sf)
    right = (F.col("y_true") == F.col("y_pred")).cast("double")
    stored = run.predictions.agg(
        F.count("*").alias("n_predicted"), F.avg(right).alias("share"), F.avg(F.col("y_true").cast("double")).alias("ones")
    )
    floor = F.greatest(F.col("ones"), 1 - F.col("ones")) - 0.05
    return run.metrics.join(F.broadcast(stored)).select(
        "n_scored", "n_predicted", (F.abs(F.col("accuracy") - F.col("share")) < 1e-6).alias("recomputed"),
        (F.col("share") >= floor).alias("above_majority"), F.lit(run.latency_mean_sec > 0).alias("timed"),
    )


@query(
    f"SELECT name, true AS in_range, true AS sum_is_one FROM (VALUES {NAMES}) t(name)"
)
def baseline_importances(spark, sf):
    """A row for every feature: its importance lies in [0, 1], all sum to 1."""
    run = _baseline(spark, sf)
    found = feature_importances(run.forest, run.predictions)
    total = found.agg(F.sum("importance").alias("_total"))
    return found.join(F.broadcast(total)).select(
        F.col("feature").alias("name"), F.col("importance").between(0, 1).alias("in_range"),
        (F.abs(F.col("_total") - 1) < 1e-9).alias("sum_is_one"),
    )


@query(
    with_(NEWS)
    + """SELECT doc_id, CAST(48 AS INTEGER) AS length, true AS finite FROM news WHERE split <> 'train'"""
)
def baseline_features(spark, sf):
    """The 48 numbers of every test row: none is missing or infinite."""
    rows = news(spark, sf)
    train = materialize(baseline.cleaned(rows.filter("split = 'train'")), "train")
    test = materialize(baseline.cleaned(rows.filter("split <> 'train'")), "test")
    vectors, affects = _lookups(train.unionByName(test))
    model = baseline.fit_features(train, vectors, 24, affects)
    out = model.transform(test)
    numbers = vector_to_array("features")
    finite = F.forall(numbers, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.select("doc_id", F.size(numbers).alias("length"), finite.alias("finite"))


PER_CLASS = 500
SAMPLE = f"""sample AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS place
    FROM news WHERE split <> 'train')
  WHERE place <= {PER_CLASS}),
composed AS (
  SELECT doc_id, label, split, {DOCUMENT} AS text FROM news),
asked_texts AS (SELECT c.doc_id, c.text FROM composed c JOIN sample s USING (doc_id)),
known_texts AS (SELECT doc_id, text FROM composed WHERE split = 'train')"""
FOUND = f"""nearest AS (
  SELECT * FROM (
    SELECT query_id, label, distance, row_number() OVER (
      PARTITION BY query_id ORDER BY distance ASC NULLS LAST, doc_id) AS rank
    FROM (
      SELECT q.doc_id AS query_id, c.doc_id, n.label, {distance_sql('q.v', 'c.v')} AS distance
      FROM asked q, known c JOIN news n ON n.doc_id = c.doc_id))
  WHERE rank <= 3)"""


@query(
    with_(
        NEWS,
        SAMPLE,
        hash_vectors_sql("asked_texts", "doc_id", "asked"),
        hash_vectors_sql("known_texts", "doc_id", "known"),
        FOUND,
        f"votes AS ({vote_sql('nearest', 'query_id')})",
    )
    + """SELECT s.doc_id, CAST(s.label AS INTEGER) AS y_true, CASE WHEN v.verdict = 'fake' THEN 0 ELSE 1 END AS y_retrieval,
  v.confidence, true AS baseline_scored, CAST(3 AS BIGINT) AS n_systems, true AS table_follows
FROM sample s JOIN votes v ON v.query_id = s.doc_id"""
)
def system_comparison(spark, sf):
    """Both systems on one sample of real articles, 500 of each class as in the
    reference or all of a class that has fewer, row by row, and
    whether the table's baseline accuracy follows from the stored rows."""
    rows = news(spark, sf)
    vectors, affects = _lookups(baseline.cleaned(rows))
    train, test = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    out = compare_on_sample(train, test, PER_CLASS, vectors, 24, affects, hashing_encoder(), Settings())
    stored = out.baseline.predictions.select("doc_id", F.col("y_pred").alias("_baseline"))
    verdicts = out.verified.select(
        F.col("query_id").alias("doc_id"), encode_verdict(F.col("verdict")).alias("y_retrieval"), "confidence"
    )
    table_ = render_na(out.table).agg(
        F.count("*").alias("n_systems"), F.max(F.when(F.col("system") == "NC-LBFV", F.col("accuracy"))).alias("_said")
    )
    right = (F.col("y_true") == F.col("y_pred")).cast("double")
    share = out.baseline.predictions.agg(F.round(F.avg(right), 4).alias("_share"))
    joined = out.sample.select("doc_id", F.col("label").alias("y_true")).join(stored, "doc_id").join(verdicts, "doc_id")
    return joined.join(F.broadcast(table_)).join(F.broadcast(share)).select(
        "doc_id", "y_true", "y_retrieval", "confidence", F.col("_baseline").isin(0, 1).alias("baseline_scored"),
        "n_systems", (F.abs(F.col("_said").cast("double") - F.col("_share")) < 1e-6).alias("table_follows"),
    )
