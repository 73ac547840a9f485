"""Prompts, verification of articles, the ablation and the streams."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import functions as F

from factlake.functions import prompt as pr
from factlake.functions.encoders import hashing_encoder
from factlake.operators import grid, scoring
from factlake.operators.scale import materialize, scratch_path
from factlake.operators.ivf import read_index, write_index
from factlake.plans import ablation, verify
from factlake.settings import Settings
from factlake.sources import tables as tb
from factlake.streaming.verify_stream import verify_stream
from registry.retrieval import CENTROIDS, given_centroids, probes_sql
from registry.tables import (
    GRID,
    KB,
    as_queries,
    distance_sql,
    kb,
    metrics_sql,
    nearest_sql,
    table,
    vote_sql,
    with_,
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


# Vectors paired with the document of the same number.
KB_TEXT = KB + """,
kb_text AS (SELECT k.*, d.text AS content FROM kb k JOIN documents d ON d.doc_id = k.vec_id)"""
NEAREST_TEXT = nearest_sql(3).replace("FROM kb q JOIN kb c", "FROM kb_text q JOIN kb_text c")
CONTEXTS = """contexts AS (
  SELECT n.query_id, string_agg('[' || n.rank || '] ' || d.text, chr(10) || chr(10) ORDER BY n.rank) AS context
  FROM nearest n JOIN documents d ON d.doc_id = n.vec_id GROUP BY n.query_id)"""
_BEFORE, _REST = pr.USER_PROMPT.split("{context}")
_BETWEEN, _AFTER = _REST.split("{query}")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PROMPT = f"{_quoted(_BEFORE)} || context || {_quoted(_BETWEEN)} || d.text || {_quoted(_AFTER)}"


def kb_text(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    return kb(spark, sf).join(texts, "vec_id")


def _verified(spark, sf, scorer=None):
    corpus = kb_text(spark, sf)
    queries = as_queries(corpus).withColumnRenamed("content", "news")
    return verify.verify(queries, corpus, Settings(), scorer, exclude_own=True)


@query(
    with_(KB_TEXT, NEAREST_TEXT, CONTEXTS) + "SELECT query_id, md5(context) AS context_md5, "
    "CAST(length(context) AS INTEGER) AS n_chars FROM contexts"
)
def retrieved_contexts(spark, sf):
    corpus = kb_text(spark, sf)
    docs = verify.retrieve(as_queries(corpus), corpus, 3, exclude_own=True)
    context = pr.build_context(F.transform("docs", lambda d: d["content"]))
    return docs.select("query_id", context.alias("context")).select(
        "query_id", F.md5("context").alias("context_md5"), F.length("context").alias("n_chars")
    )


@query(
    with_(KB_TEXT, NEAREST_TEXT, CONTEXTS, f"votes AS ({vote_sql('nearest', 'query_id')})")
    + f"""SELECT c.query_id, md5({PROMPT}) AS prompt_md5, v.verdict, v.confidence, true AS is_valid
FROM contexts c JOIN documents d ON d.doc_id = c.query_id JOIN votes v ON v.query_id = c.query_id"""
)
def verify_articles(spark, sf):
    """Every article with a vector against the others: retrieval, prompt, vote."""
    return _verified(spark, sf).select(
        "query_id", F.md5("prompt").alias("prompt_md5"), "verdict", "confidence", "is_valid"
    )


def _long_prompt(request: dict) -> tuple[str, str]:
    label = "fake" if len(request["prompt"]) > 4000 else "real"
    system = md5(request["system"].encode()).hexdigest()
    raw = f'{{"label": "{label}", "confidence": 1, "reasoning": "{request["num_ctx"]}"}}'
    return raw, f'{request["thinking"]} {system} {len(request["prompt"])}'


@query(
    with_(KB_TEXT, NEAREST_TEXT, CONTEXTS)
    + f"""SELECT c.query_id, CASE WHEN length({PROMPT}) > 4000 THEN 'fake' ELSE 'real' END AS verdict,
  CAST(1.0 AS DOUBLE) AS confidence, '2048' AS reasoning,
  'True ' || md5({_quoted(pr.SYSTEM_PROMPT)}) || ' ' || length({PROMPT}) AS thinking, true AS timed
FROM contexts c JOIN documents d ON d.doc_id = c.query_id"""
)
def verify_with_scorer(spark, sf):
    """The same with a user's scorer, which sees system rules, filled prompt
    and thinking flag."""
    timed = F.col("time_elapsed_llm").rlike(r"^\d+m\d+s$") & (F.col("elapsed_sec") >= 0)
    return _verified(spark, sf, _long_prompt).select(
        "query_id", "verdict", "confidence", "reasoning", "thinking", timed.alias("timed")
    )


def _own_settings(queries):
    """Every third article asks for more neighbours, every fourth for another
    temperature; the others leave both open."""
    number = F.col("query_id")
    return queries.withColumns(
        {
            "top_k": F.when(number % 3 == 0, 5).cast("int"),
            "temperature": F.when(number % 4 == 0, 0.5).cast("double"),
        }
    )


def _echo(request: dict) -> str:
    docs = request["prompt"].count("\n\n[") + 1
    return (
        f'{{"label": "real", "confidence": {request["temperature"]}, '
        f'"reasoning": "{request["num_ctx"]}"}}' if docs else ""
    )


@query(
    with_(KB_TEXT)
    + """SELECT vec_id AS query_id, CAST(CASE WHEN vec_id % 3 = 0 THEN 5 ELSE 2 END AS INTEGER) AS n_docs,
  CAST(CASE WHEN vec_id % 4 = 0 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS confidence,
  CAST(least(2048, greatest(2048, 384 * ((CASE WHEN vec_id % 3 = 0 THEN 5 ELSE 2 END) + 1) + 1024)) AS VARCHAR)
    AS reasoning
FROM kb_text"""
)
def verify_own_settings(spark, sf):
    """Articles with their own number of neighbours and temperature."""
    corpus = kb_text(spark, sf)
    queries = _own_settings(as_queries(corpus).withColumnRenamed("content", "news"))
    settings = Settings(chunk_type="sliding", top_k=2, temperature=0.25)
    out = verify.verify(queries, corpus, settings, _echo, exclude_own=True)
    return out.select("query_id", F.size("docs").alias("n_docs"), "confidence", "reasoning")


NEAREST_LISTS = """nearest AS (
  SELECT * FROM (
    SELECT query_id, vec_id, label, distance, row_number() OVER (
      PARTITION BY query_id ORDER BY distance ASC NULLS LAST, vec_id) AS rank
    FROM (
      SELECT q.vec_id AS query_id, c.vec_id, c.label, {distance} AS distance
      FROM probes p JOIN lists l ON p.list_id = l.list_id AND p.vec_id <> l.vec_id
      JOIN kb_text q ON q.vec_id = p.vec_id JOIN kb_text c ON c.vec_id = l.vec_id))
  WHERE rank <= 3)""".format(distance=distance_sql("q.embedding", "c.embedding"))


@query(
    with_(
        KB_TEXT,
        CENTROIDS,
        probes_sql("kb_text", "vec_id", 2, "probes"),
        probes_sql("kb_text", "vec_id", 1, "lists"),
        NEAREST_LISTS,
        CONTEXTS,
        f"votes AS ({vote_sql('nearest', 'query_id')})",
    )
    + f"""SELECT c.query_id, md5({PROMPT}) AS prompt_md5, v.verdict, v.confidence, true AS is_valid
FROM contexts c JOIN documents d ON d.doc_id = c.query_id JOIN votes v ON v.query_id = c.query_id"""
)
def verify_articles_ivf(spark, sf):
    """The same against a stored index: lists of given centroids, two probes."""
    path = scratch_path(spark, "index")
    write_index(kb_text(spark, sf), path, given_centroids(spark, sf))
    corpus, index = read_index(spark, path, probes=2)
    queries = as_queries(corpus.drop("list_id")).withColumnRenamed("content", "news")
    out = verify.verify(queries, corpus, Settings(), exclude_own=True, index=index)
    return out.select("query_id", F.md5("prompt").alias("prompt_md5"), "verdict", "confidence", "is_valid")


SYSTEM = _quoted(f"SYSTEM PROMPT:\n{pr.SYSTEM_PROMPT}\n\nUSER_PROMPT:\n")


@query(
    with_(KB_TEXT, NEAREST_TEXT, CONTEXTS, f"votes AS ({vote_sql('nearest', 'query_id')})")
    + f"""SELECT md5(d.text) AS news_md5, md5({SYSTEM} || {PROMPT}) AS prompt_md5,
  CASE WHEN length({PROMPT}) > 4000 THEN 'fake' ELSE 'real' END AS label, CAST(1.0 AS DOUBLE) AS confidence,
  'True ' || md5({_quoted(pr.SYSTEM_PROMPT)}) || ' ' || length({PROMPT}) AS llm_reasoning,
  md5(r.texts) AS docs_md5, r.labels, r.distances, true AS stamped
FROM contexts c JOIN documents d ON d.doc_id = c.query_id JOIN (
  SELECT n.query_id, string_agg(t.text, chr(10) ORDER BY n.rank) AS texts,
    string_agg(CAST(n.label AS VARCHAR), ',' ORDER BY n.rank) AS labels, round(sum(n.distance), 6) AS distances
  FROM nearest n JOIN documents t ON t.doc_id = n.vec_id GROUP BY n.query_id) r ON r.query_id = c.query_id"""
)
def audit_log(spark, sf):
    """Verified articles appended to the log and read back."""
    path = scratch_path(spark, "audit")
    tb.log_verifications(_verified(spark, sf, _long_prompt), path)
    docs = F.from_json("retrieved_docs", "array<array<string>>")
    each = lambda i: F.transform(docs, lambda d: F.get(d, F.lit(i)))
    apart = F.aggregate(each(2), F.lit(0.0), lambda s, d: s + d.cast("double"))
    return tb.read_verifications(spark, path).select(
        F.md5("news_content").alias("news_md5"),
        F.md5("prompt").alias("prompt_md5"),
        "label",
        "confidence",
        "llm_reasoning",
        F.md5(F.array_join(each(0), "\n")).alias("docs_md5"),
        F.array_join(each(1), ",").alias("labels"),
        F.round(apart, 6).alias("distances"),
        F.col("created_at").isNotNull().alias("stamped"),
    )


# Two models (the vector, or sums and differences of its neighbouring numbers)
# and two chunkings (the vector, or its halves as two chunks).
VARIANTS = """models AS (
  SELECT 'EMB-A' AS embedding, vec_id AS source_index, label, embedding AS v FROM kb
  UNION ALL SELECT 'EMB-B', vec_id, label,
    list_transform(range(1, 33), lambda i: embedding[2 * i - 1] + 2 * embedding[2 * i])
    || list_transform(range(1, 33), lambda i: 2 * embedding[2 * i - 1] - embedding[2 * i]) FROM kb),
chunks AS (
  SELECT embedding, 'CHUNK-A' AS chunking, source_index, source_index AS vec_id, label, v FROM models
  UNION ALL
  SELECT embedding, 'CHUNK-B', source_index, source_index * 2 + part, label,
    list_transform(v, lambda x, i: CASE WHEN (i <= len(v) // 2) = (part = 0) THEN x ELSE 0.0 END)
  FROM models, (VALUES (0), (1)) p(part))"""


def _turned(v):
    """Other 64 numbers that depend on all of the vector's."""
    pairs = F.sequence(F.lit(0), F.lit(31))
    sums = F.transform(pairs, lambda i: F.get(v, 2 * i) + 2 * F.get(v, 2 * i + 1))
    return F.concat(sums, F.transform(pairs, lambda i: 2 * F.get(v, 2 * i) - F.get(v, 2 * i + 1)))


def variants(spark, sf):
    vectors = kb(spark, sf).withColumn("embedding", F.col("embedding").cast("array<double>"))
    models = {
        "EMB-A": vectors,
        "EMB-B": vectors.withColumn("embedding", _turned(F.col("embedding"))),
    }
    halves = {}
    for name, model in models.items():
        halves[name, "CHUNK-A"] = model
        parts = model.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("part"))
        middle = F.size("embedding") / 2
        cut = F.transform(
            "embedding",
            lambda x, i: F.when((i < middle) == (F.col("part") == 0), x).otherwise(0.0),
        )
        halves[name, "CHUNK-B"] = parts.withColumns(
            {"embedding": cut, "vec_id": F.col("source_index") * 2 + F.col("part")}
        ).drop("part")
    return {n: as_queries(m) for n, m in models.items()}, halves


RANKED = f"""ranked AS (
  SELECT * FROM (
    SELECT embedding, chunking, query_id, label, distance, row_number() OVER (
      PARTITION BY embedding, chunking, query_id ORDER BY distance ASC NULLS LAST, vec_id) AS rank
    FROM (
      SELECT c.embedding, c.chunking, q.source_index AS query_id, c.vec_id, c.label,
        {distance_sql('q.v', 'c.v')} AS distance
      FROM models q JOIN chunks c
        ON q.embedding = c.embedding AND q.source_index <> c.source_index))
  WHERE rank <= 10),
taken AS (
  SELECT g.config_id, r.query_id, r.label, r.distance
  FROM ranked r JOIN grid g
    ON g.embedding = r.embedding AND g.chunking = r.chunking AND r.rank <= g.top_k)"""
ABLATION = with_(
    KB,
    VARIANTS,
    GRID,
    RANKED,
    f"votes AS ({vote_sql('taken', 'config_id, query_id')})",
    """aligned AS (
  SELECT config_id, query_id, k.label AS y_true, CASE WHEN verdict = 'fake' THEN 0 ELSE 1 END AS y_pred
  FROM votes v JOIN kb k ON k.vec_id = v.query_id)""",
    metrics_sql("aligned", "config_id"),
)


def run_grid(spark, sf, path=None, done=None, indexed=False, store=None):
    queries, kbs = variants(spark, sf)
    indexes = {}
    if indexed:
        for name, vectors in list(kbs.items()):
            folder = scratch_path(spark, "index")
            write_index(vectors, folder, _unit_lists(spark))
            kbs[name], indexes[name] = read_index(spark, folder, probes=20)
    truth = kb(spark, sf).select(F.col("vec_id").alias("doc_id"), "label")
    return ablation.run_ablation(
        grid.config_grid(spark), done, queries, kbs, truth, path, exclude_own=True, indexes=indexes, store=store
    )


def _unit_lists(spark):
    """64 given centroids: list i is along number i of a vector."""
    entry = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i == F.col("list_id")).cast("double"))
    return spark.range(64).select(F.col("id").cast("int").alias("list_id")).select("list_id", entry.alias("embedding"))


ABLATION_COLUMNS = ["config_id", "embedding", "chunking", "top_k", "temperature", "n_scored"]
ABLATION_METRICS = ["accuracy", "precision", "recall", "specificity", "f1"]
ABLATION_SELECT = ", ".join(ABLATION_COLUMNS) + "".join(
    f", round({c}, 4) AS {c}" for c in ABLATION_METRICS
)


@query(ABLATION + f"SELECT {ABLATION_SELECT} FROM metrics JOIN grid USING (config_id)")
def ablation_results(spark, sf):
    """All 32 configurations over all vectors."""
    return run_grid(spark, sf).select(*ABLATION_COLUMNS, *ABLATION_METRICS)


# The nearest axes of a vector are those of its largest numbers.
def _axes_sql(source: str, key: str, n: int, name: str) -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT embedding, {key}, list_id, row_number() OVER (PARTITION BY embedding, {key} ORDER BY d, list_id) AS place
    FROM (
      SELECT embedding, {key}, i AS list_id,
        round(1 - v[i + 1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 9) AS d
      FROM {source}, (SELECT unnest(range(0, 64)) AS i)))
  WHERE place <= {n})"""


LISTED = f"""{_axes_sql('models', 'source_index', 20, 'probes')},
parts AS (SELECT embedding || ' ' || chunking AS embedding, vec_id, v FROM chunks),
{_axes_sql('parts', 'vec_id', 1, 'lists')}"""
RANKED_LISTS = RANKED.replace(
    "ON q.embedding = c.embedding AND q.source_index <> c.source_index",
    """ON q.embedding = c.embedding AND q.source_index <> c.source_index
      JOIN lists l ON l.embedding = c.embedding || ' ' || c.chunking AND l.vec_id = c.vec_id
      JOIN probes p ON p.embedding = q.embedding AND p.source_index = q.source_index
        AND p.list_id = l.list_id""",
)


@query(ABLATION.replace(RANKED, LISTED + ",\n" + RANKED_LISTS) + f"SELECT {ABLATION_SELECT} FROM metrics JOIN grid USING (config_id)")
def ablation_results_ivf(spark, sf):
    """All 32 configurations against stored indexes."""
    return run_grid(spark, sf, indexed=True).select(*ABLATION_COLUMNS, *ABLATION_METRICS)


@query(
    ABLATION
    + "SELECT config_id, embedding, chunking, top_k, temperature, thinking, round(accuracy, 4) AS accuracy, "
    "round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1 "
    "FROM metrics JOIN grid USING (config_id)"
)
def ablation_resumed(spark, sf):
    """A run that stopped half-way and was taken up again, from its CSV files
    and the neighbours that it had found."""
    path, store = scratch_path(spark, "results"), scratch_path(spark, "neighbours")
    first = run_grid(spark, sf, store=store).filter("config_id % 2 = 0")
    tb.append_results(first, path)
    run_grid(spark, sf, path, done=tb.read_results(spark, path), store=store)
    return tb.read_results(spark, path).drop("latency_mean_sec")


@query(
    ABLATION.replace(GRID, """grid AS (
  SELECT 1 AS config_id, 'EMB-A' AS embedding, 'CHUNK-A' AS chunking, 3 AS top_k, false AS thinking
  UNION ALL SELECT 2, 'EMB-A', 'CHUNK-A', 3, true)""")
    .replace("CASE WHEN verdict = 'fake' THEN 0 ELSE 1 END AS y_pred", "CASE WHEN config_id = 2 THEN 0 ELSE 1 END AS y_pred")
    + "SELECT config_id, embedding, chunking, top_k, thinking, n_scored, round(f1, 4) AS f1 "
    "FROM metrics JOIN grid USING (config_id)"
)
def thinking_comparison(spark, sf):
    """Two configurations that differ in the thinking flag only, and a scorer
    that answers by it."""
    axes = {"embeddings": ["EMB-A"], "chunkings": ["CHUNK-A"], "temperatures": [0.0], "top_ks": [3]}
    pair = grid.config_grid(spark, **axes, thinking=[False, True])
    queries, kbs = variants(spark, sf)
    kbs = {("EMB-A", "CHUNK-A"): kbs["EMB-A", "CHUNK-A"]}
    truth = kb(spark, sf).select(F.col("vec_id").alias("doc_id"), "label")
    number = F.col("vec_id").cast("string")
    queries = {"EMB-A": queries["EMB-A"].withColumn("news", number)}
    kbs = {name: vectors.withColumn("content", number) for name, vectors in kbs.items()}
    out = ablation.run_ablation(pair, None, queries, kbs, truth, scorer=_by_flag, exclude_own=True, max_k=3)
    return out.select("config_id", "embedding", "chunking", "top_k", "thinking", "n_scored", "f1")


def _by_flag(request: dict) -> str:
    label = "fake" if request["thinking"] else "real"
    return f'{{"label": "{label}", "confidence": 1, "reasoning": ""}}'


HASH_KB = """tokens AS (
  SELECT doc_id, unnest(list_filter(string_split_regex(text, '[\\s\\v]+'), lambda w: w <> '')) AS w FROM documents),
digits AS (
  SELECT doc_id, instr('0123456789abcdef', substr(md5(w), 1, 1)) - 1 AS i, count(*) AS n FROM tokens GROUP BY 1, 2),
hashed AS (
  SELECT doc_id, i, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT) AS x FROM digits)"""


@query(
    with_(HASH_KB)
    + "SELECT doc_id, CAST(i AS INTEGER) AS dim, round(CAST(x AS DOUBLE), 6) AS value FROM hashed"
)
def embed_documents(spark, sf):
    """Every document through a batch encoder; the non-zero numbers."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    embedded = scoring.embed(docs, hashing_encoder())
    entries = embedded.select("doc_id", F.posexplode("embedding").alias("dim", "x"))
    return entries.filter("x <> 0").select(
        "doc_id", "dim", F.round(F.col("x").cast("double"), 6).alias("value")
    )


def hash_vectors_sql(source: str, key: str, name: str) -> str:
    """Unit vectors of 16 single-precision numbers, as the hashing encoder makes."""
    return f"""{name}_words AS (
  SELECT {key}, instr('0123456789abcdef', substr(md5(w), 1, 1)) - 1 AS i, count(*) AS n
  FROM (SELECT {key}, unnest(list_filter(string_split_regex(text, '[\\s\\v]+'), lambda w: w <> '')) AS w
        FROM {source}) GROUP BY 1, 2),
{name}_long AS (
  SELECT {key}, i, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS x FROM {name}_words),
{name} AS (
  SELECT s.{key}, list(CAST(coalesce(l.x, 0) AS DOUBLE) ORDER BY d.i) AS v
  FROM {source} s CROSS JOIN (SELECT unnest(range(0, 16)) AS i) d
  LEFT JOIN {name}_long l ON l.{key} = s.{key} AND l.i = d.i GROUP BY 1)"""


TURNS = """turns AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations)"""
ARRIVALS = with_(
    TURNS,
    hash_vectors_sql("turns", "query_id", "asked"),
    hash_vectors_sql("documents", "doc_id", "known"),
    f"""nearest AS (
  SELECT * FROM (
    SELECT query_id, label, distance, row_number() OVER (
      PARTITION BY query_id ORDER BY distance ASC NULLS LAST, doc_id) AS rank
    FROM (
      SELECT q.query_id, c.doc_id, d.n_chars % 2 AS label, {distance_sql('q.v', 'c.v')} AS distance
      FROM asked q, known c JOIN documents d ON d.doc_id = c.doc_id))
  WHERE rank <= 3)""",
    f"votes AS ({vote_sql('nearest', 'query_id')})",
)


@query(
    ARRIVALS
    + "SELECT md5(t.text) AS news_md5, v.verdict AS label, v.confidence "
    "FROM votes v JOIN turns t ON t.query_id = v.query_id"
)
def verify_arrivals(spark, sf):
    """Conversation turns arrive as files and are verified against documents."""
    arrivals = scratch_path(spark, "arrivals")
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("news")
    )
    turns.repartition(4).write.parquet(arrivals)
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("vec_id"),
        F.col("text").alias("content"),
        (F.col("n_chars") % 2).cast("int").alias("label"),
    )
    corpus = materialize(scoring.embed(docs, hashing_encoder()), "corpus")
    log = scratch_path(spark, "log")
    stream = spark.readStream.schema(turns.schema).parquet(arrivals)
    verify_stream(
        stream, corpus, hashing_encoder(), Settings(), log, scratch_path(spark, "checkpoint")
    ).awaitTermination()
    return tb.read_verifications(spark, log).select(
        F.md5("news_content").alias("news_md5"), "label", "confidence"
    )
