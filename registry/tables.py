"""Inputs of the queries, derived from the given tables: once as DataFrames and
once as SQL text (common table expressions) with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions.vectors import DISTANCE_DIGITS
from factlake.operators.features import EMOTIONS
from factlake.operators.grid import config_grid
from factlake.operators.scale import spread
from factlake.operators.scoring import parse_scores


# Tables whose rows are costly to work on, with their key.
HEAVY = {"documents": "doc_id", "pages": "page_id", "embeddings": "vec_id", "events": "event_id"}


SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "events": "event_id long, user_id long, event_type string, value double",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")
    return spread(df, HEAVY[name]) if name in HEAVY else df


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --- articles: every document, its first line as the title -----------------

ARTICLES = """articles AS (
  SELECT doc_id,
    CASE WHEN instr(text, chr(10)) > 0 AND doc_id % 10 <> 0
         THEN substr(text, 1, instr(text, chr(10)) - 1) END AS title,
    CASE WHEN instr(text, chr(10)) > 0
         THEN substr(text, instr(text, chr(10)) + 1) ELSE text END AS text
  FROM documents)"""


def articles(spark: SparkSession, sf: str) -> DataFrame:
    at = F.instr("text", "\n")
    lines = table(spark, sf, "documents").select("doc_id", "text", at.alias("at"))
    whole = F.col("text")
    title = F.when(
        (F.col("at") > 0) & (F.col("doc_id") % 10 != 0),
        F.substr(whole, F.lit(1), F.col("at") - 1),
    )
    rest = F.when(F.col("at") > 0, F.substr(whole, F.col("at") + 1)).otherwise(whole)
    return lines.select("doc_id", title.alias("title"), rest.alias("text"))


# --- news: the labelled articles, with a split -----------------------------

NEWS = (
    ARTICLES
    + """,
news AS (
  SELECT a.doc_id, a.title, a.text, CAST(l.quality AS INTEGER) AS label,
    CASE WHEN a.doc_id % 10 < 7 THEN 'train' WHEN a.doc_id % 10 < 9 THEN 'test'
         ELSE 'validation' END AS split,
    row_number() OVER (ORDER BY a.doc_id) - 1 AS source_index
  FROM articles a JOIN labels l ON a.doc_id = l.doc_id)"""
)


def news(spark: SparkSession, sf: str) -> DataFrame:
    """Without `source_index`, which `with_source_index` adds."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    slot = F.col("doc_id") % 10
    split = F.when(slot < 7, "train").when(slot < 9, "test").otherwise("validation")
    return articles(spark, sf).join(labels, "doc_id").withColumn("split", split)


# --- vectors: the embeddings, labels folded to two classes -----------------

KB = """kb AS (
  SELECT vec_id, vec_id AS source_index, CAST(embedding AS DOUBLE[]) AS embedding,
    CASE WHEN label < 5 THEN 0 ELSE 1 END AS label
  FROM embeddings)"""


def kb(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("label") < 5, 0).otherwise(1)
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("vec_id").alias("source_index"), "embedding", label.alias("label")
    )


def as_queries(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("query_id", F.col("source_index"))


def distance_sql(a: str, b: str) -> str:
    """Rounded cosine distance; NULL for a zero vector."""
    raw = f"list_cosine_distance({a}, {b})"
    return f"CASE WHEN isnan({raw}) THEN NULL ELSE round({raw}, {DISTANCE_DIGITS}) END"


def nearest_sql(k: int, name: str = "nearest") -> str:
    """The k nearest rows of `kb` for each of its rows, itself left out."""
    return f"""{name} AS (
  SELECT * FROM (
    SELECT query_id, vec_id, label, distance, row_number() OVER (
      PARTITION BY query_id ORDER BY distance ASC NULLS LAST, vec_id) AS rank
    FROM (
      SELECT q.vec_id AS query_id, c.vec_id, c.label,
        {distance_sql("q.embedding", "c.embedding")} AS distance
      FROM kb q JOIN kb c ON q.vec_id <> c.vec_id))
  WHERE rank <= {k})"""


def vote_sql(source: str, keys: str, max_distance: float = 1.0) -> str:
    """Select list and grouping of the built-in vote over (label, distance)."""

    def weight(label: int) -> str:
        return (
            f"coalesce(sum(1 - distance) FILTER (label = {label} "
            f"AND distance <= {max_distance}), 0)"
        )

    return f"""SELECT {keys},
    CASE WHEN {weight(1)} > {weight(0)} THEN 'real' ELSE 'fake' END AS verdict,
    CASE WHEN {weight(1)} + {weight(0)} = 0 THEN 0.0 ELSE
      round(greatest({weight(1)}, {weight(0)}) / ({weight(1)} + {weight(0)}), 6)
    END AS confidence
  FROM {source} GROUP BY {keys}"""


# --- verdicts: every event as one answered question, some of them broken ----

VERDICTS = """calls AS (
  SELECT event_id AS doc_id, event_id // 32 AS position,
    CAST(event_id % 32 + 1 AS INTEGER) AS config_id,
    CAST((event_id // 32 + user_id) % 2 AS INTEGER) AS label,
    sqrt(value) AS latency,
    CASE WHEN event_id % 17 <> 0 THEN 0 ELSE 1 + event_id // 17 % 4 END AS fault,
    CASE WHEN (user_id + length(event_type)) % 3 = 0 THEN 'fake' ELSE 'real' END AS guess,
    event_id % 10 AS tenth, event_type
  FROM events),
scored AS (
  SELECT doc_id, position, config_id, label,
    CASE WHEN fault = 1 THEN NULL ELSE latency END AS latency_sec,
    CASE fault
      WHEN 1 THEN ''
      WHEN 2 THEN '{"label": "maybe", "confidence": 0.5, "reasoning": "r"}'
      WHEN 3 THEN '{"label": "' || guess || '", "confidence": 1.5, "reasoning": "r"}'
      WHEN 4 THEN '{"label": "' || guess || '", "confidence": 0.5}'
      ELSE '{"label": "' || guess || '", "confidence": 0.' || tenth ||
           ', "reasoning": "' || event_type || '", "note": 1}'
    END AS raw
  FROM calls),
fields AS (
  SELECT *, CASE WHEN json_valid(raw) AND raw <> '' THEN raw::JSON END AS doc FROM scored),
checked AS (
  SELECT *,
    CASE WHEN raw IS NULL OR trim(raw) = '' THEN 'empty'
      WHEN doc IS NULL OR json_type(doc) <> 'OBJECT' THEN 'not an object'
      WHEN coalesce(json_type(doc, '$.label'), '') <> 'VARCHAR'
        OR json_extract_string(doc, '$.label') NOT IN ('fake', 'real') THEN 'label'
      WHEN NOT coalesce(TRY_CAST(json_extract_string(doc, '$.confidence') AS DOUBLE)
        BETWEEN 0 AND 1, false) THEN 'confidence'
      WHEN coalesce(json_type(doc, '$.reasoning'), '') <> 'VARCHAR' THEN 'reasoning'
    END AS error
  FROM fields),
verdicts AS (
  SELECT doc_id, position, config_id, label, latency_sec, error IS NULL AS is_valid, error,
    CASE WHEN error IS NULL THEN json_extract_string(doc, '$.label') END AS verdict,
    CASE WHEN error IS NULL
      THEN CAST(json_extract_string(doc, '$.confidence') AS DOUBLE) END AS confidence,
    CASE WHEN error IS NULL THEN json_extract_string(doc, '$.reasoning') END AS reasoning
  FROM checked),
aligned AS (
  SELECT doc_id, config_id, latency_sec, label AS y_true,
    CASE WHEN verdict = 'fake' THEN 0 ELSE 1 END AS y_pred
  FROM verdicts WHERE is_valid)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, position, config_id, label, latency_sec, raw, call_error."""
    event, kind = F.col("event_id"), F.col("event_type")
    at = F.expr("event_id div 32")
    fault = F.when(event % 17 != 0, 0).otherwise(1 + F.expr("event_id div 17") % 4)
    guess = F.when((F.col("user_id") + F.length(kind)) % 3 == 0, "fake").otherwise("real")
    opening = F.concat(F.lit('{"label": "'), guess, F.lit('", "confidence": '))
    tenth = (event % 10).cast("string")
    raw = (
        F.when(F.col("fault") == 1, "")
        .when(F.col("fault") == 2, '{"label": "maybe", "confidence": 0.5, "reasoning": "r"}')
        .when(F.col("fault") == 3, F.concat(opening, F.lit('1.5, "reasoning": "r"}')))
        .when(F.col("fault") == 4, F.concat(opening, F.lit("0.5}")))
        .otherwise(
            F.concat(
                opening, F.lit("0."), tenth, F.lit(', "reasoning": "'), kind, F.lit('", "note": 1}')
            )
        )
    )
    return (
        table(spark, sf, "events")
        .withColumn("fault", fault)
        .select(
            event.alias("doc_id"),
            at.alias("position"),
            (event % 32 + 1).cast("int").alias("config_id"),
            ((at + F.col("user_id")) % 2).cast("int").alias("label"),
            F.when(F.col("fault") != 1, F.sqrt("value")).alias("latency_sec"),
            raw.alias("raw"),
            F.lit(None).cast("string").alias("call_error"),
        )
    )


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return parse_scores(scored(spark, sf))


# --- results: metrics of those verdicts by configuration -------------------

GRID = """grid AS (
  SELECT CAST(row_number() OVER (ORDER BY embedding, chunking, temperature, top_k) AS INTEGER)
    AS config_id, embedding, chunking, CAST(top_k AS INTEGER) AS top_k, temperature,
    false AS thinking, CASE chunking WHEN 'CHUNK-A' THEN 'full' ELSE 'sliding' END AS chunk_type
  FROM (VALUES ('EMB-A'), ('EMB-B')) e(embedding), (VALUES ('CHUNK-A'), ('CHUNK-B')) c(chunking),
    (VALUES (CAST(0.0 AS DOUBLE)), (0.3)) t(temperature), (VALUES (1), (3), (5), (10)) k(top_k))"""


def metrics_sql(source: str, by: str, name: str = "metrics", pos: int = 0) -> str:
    """Counts and unrounded metrics by `by`."""
    return f"""{name}_counts AS (
  SELECT {by},
    count(*) FILTER (y_true = {pos} AND y_pred = {pos}) AS tp,
    count(*) FILTER (y_true <> {pos} AND y_pred = {pos}) AS fp,
    count(*) FILTER (y_true = {pos} AND y_pred <> {pos}) AS fn,
    count(*) FILTER (y_true <> {pos} AND y_pred <> {pos}) AS tn,
    count(*) AS n_scored
  FROM {source} GROUP BY {by}),
{name} AS (
  SELECT *, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) AS accuracy,
    coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
    coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
    coalesce(tn / nullif(tn + fp, 0), 0) AS specificity,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1
  FROM {name}_counts)"""


RESULTS = ",\n".join(
    [
        VERDICTS,
        GRID,
        metrics_sql("aligned", "config_id"),
        """results AS (
  SELECT g.config_id, g.embedding, g.chunking, g.top_k, g.temperature, g.thinking,
    round(accuracy, 4) AS accuracy, round(precision, 4) AS precision,
    round(recall, 4) AS recall, round(specificity, 4) AS specificity, round(f1, 4) AS f1,
    round(latency_mean_sec, 4) AS latency_mean_sec
  FROM metrics m JOIN grid g USING (config_id)
  LEFT JOIN (SELECT config_id, avg(latency_sec) AS latency_mean_sec FROM aligned
             WHERE latency_sec IS NOT NULL GROUP BY 1) t USING (config_id))""",
    ]
)


def results(spark: SparkSession, sf: str) -> DataFrame:
    from factlake.plans.ablation import summarise
    from factlake.schemas import results_schema

    answers = verdicts(spark, sf).withColumnRenamed("doc_id", "query_id")
    truth = answers.select("query_id", "label")
    table_ = summarise(answers.drop("label"), truth, config_grid(spark))
    return table_.select(*results_schema(with_specificity=True).names)


# --- words: lexicon and word vectors made from the words themselves --------

AFFECTS = EMOTIONS + ["positive", "negative"]
VECTOR_DIM = 8


def hex_digit(place: int, word: str = "word"):
    return F.conv(F.substring(F.md5(word), place, 1), 16, 10).cast("int")


def hex_digit_sql(place: str, word: str = "word") -> str:
    return f"(instr('0123456789abcdef', substr(md5({word}), {place}, 1)) - 1)"


def lexicon(words: DataFrame) -> DataFrame:
    """word, affect: up to two affects of a word, by digits of its md5."""
    names = F.array(*[F.lit(a) for a in AFFECTS])
    picks = F.array_distinct(F.array(hex_digit(1), hex_digit(2)))
    return words.select("word", F.explode(picks).alias("at")).filter(
        F.col("at") < len(AFFECTS)
    ).select("word", F.element_at(names, F.col("at") + 1).alias("affect"))


def lexicon_sql(words: str) -> str:
    names = ", ".join(f"'{a}'" for a in AFFECTS)
    return f"""lexicon AS (
  SELECT DISTINCT word, list_extract([{names}], slot + 1) AS affect FROM (
    SELECT word, {hex_digit_sql('1')} AS slot FROM {words}
    UNION ALL SELECT word, {hex_digit_sql('2')} FROM {words}) WHERE slot < {len(AFFECTS)})"""


def word_vectors(words: DataFrame) -> DataFrame:
    digits = [(hex_digit(i) - 7.5) / 7.3 for i in range(1, VECTOR_DIM + 1)]
    return words.select("word", F.array(*digits).alias("vector"))


def word_vectors_sql(words: str) -> str:
    digits = ", ".join(
        f"({hex_digit_sql(str(i))} - CAST(7.5 AS DOUBLE)) / 7.3" for i in range(1, VECTOR_DIM + 1)
    )
    return f"vectors AS (SELECT word, [{digits}] AS vector FROM {words})"
