"""Life cycle of the knowledge base."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.functions.encoders import hashing_encoder
from factlake.operators import chunking, kb as state, sampling
from factlake.operators.scale import materialize, scratch_path
from factlake.plans import index
from factlake.schemas import NEWS as NEWS_SCHEMA
from factlake.sources import kb as store, versions
from factlake.sources.growing_index import variant_index
from factlake.streaming.index_stream import index_stream, news_stream
from registry.news import DOCUMENT, sliding_sql, words_sql
from registry.tables import NEWS, news, with_

QUERIES = {}
SQL = {}
ENCODERS = {"EMB-A": hashing_encoder(0), "EMB-B": hashing_encoder(1)}
MODELS = "(VALUES ('EMB-A'), ('EMB-B')) m(embedding_model)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


DOCS = NEWS + f",\ndocs AS (SELECT source_index, label, {DOCUMENT} AS content FROM news)"
CHUNKS = (
    DOCS
    + ",\nchunks AS ("
    + sliding_sql("docs", "source_index, label")
    + ")"
)
ROWS = CHUNKS + f""",
rows AS (
  SELECT embedding_model, chunking, source_index, chunk_no, CAST(label AS INTEGER) AS label, md5(content) AS content_md5
  FROM (SELECT 'CHUNK-A' AS chunking, source_index, 0 AS chunk_no, label, content FROM docs
        UNION ALL SELECT 'CHUNK-B', source_index, chunk_no, label, content FROM chunks), {MODELS})"""


def numbered(spark, sf):
    return sampling.with_source_index(news(spark, sf), "doc_id")


def _shown(kb):
    return kb.select(
        "embedding_model",
        "chunking",
        "source_index",
        "chunk_no",
        F.col("label").cast("int").alias("label"),
        F.md5("content").alias("content_md5"),
    )


def _built(spark, sf):
    """The knowledge base of all labelled articles, in three commits."""
    path = scratch_path(spark, "kb")
    docs = materialize(numbered(spark, sf), "news")
    size = docs.agg(F.ceil(F.count("*") / 3).cast("int")).first()[0]
    index.build_kb(docs, path, ENCODERS, rows_per_commit=size)
    return path


@query(with_(ROWS) + "SELECT * FROM rows")
def kb_build(spark, sf):
    return _shown(store.read_kb(spark, _built(spark, sf)))


@query(
    with_(ROWS)
    + "SELECT embedding_model, chunking, source_index, chunk_no, label, CAST(1 AS BIGINT) AS n_places FROM rows"
)
def kb_indexed(spark, sf):
    """The inverted lists that grew with the knowledge base: two thirds of the
    articles by commits, the rest as a stream."""
    path, root = scratch_path(spark, "kb"), scratch_path(spark, "lists")
    docs = materialize(numbered(spark, sf), "news")
    size = docs.agg(F.ceil(F.count("*") / 3).cast("int")).first()[0]
    first = docs.filter(F.col("source_index") < 2 * size)
    index.build_kb(first, path, ENCODERS, rows_per_commit=size, index_root=root, lists=5)
    arrived = scratch_path(spark, "arrivals")
    late = docs.filter(F.col("source_index") >= 2 * size)
    late.select(*[F.col(f.name).cast(f.dataType) for f in NEWS_SCHEMA]).write.parquet(arrived)
    stream = index_stream(
        news_stream(spark, arrived), path, ENCODERS, scratch_path(spark, "checkpoint"), root, lists=5
    )
    stream.awaitTermination()
    out = None
    for model, chunking_ in index.variants_of(ENCODERS):
        members = variant_index(spark, root, model, chunking_).members()
        part = members.withColumns({"embedding_model": F.lit(model), "chunking": F.lit(chunking_)})
        out = part if out is None else out.unionByName(part)
    keys = ["embedding_model", "chunking", "source_index", "chunk_no"]
    return out.groupBy(*keys, F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n_places"))


@query(with_(ROWS) + "SELECT * FROM rows WHERE embedding_model = 'EMB-B' AND chunking = 'CHUNK-B'")
def kb_scan(spark, sf):
    return _shown(store.read_kb(spark, _built(spark, sf), "EMB-B", "CHUNK-B"))


@query(with_(ROWS) + "SELECT * FROM rows")
def kb_snapshot(spark, sf):
    """Written as a snapshot and restored from it."""
    root = scratch_path(spark, "snapshots")
    store.snapshot_kb(store.read_kb(spark, _built(spark, sf)), root)
    return _shown(store.restore_kb(spark, root))


THIRDS = """sized AS (SELECT CAST(ceil(count(*) / 3) AS INTEGER) AS size FROM news),
told AS (SELECT rows.*, CAST(source_index // size AS INTEGER) AS part, size FROM rows, sized)"""
TOLD = "embedding_model, chunking, source_index, chunk_no, label, content_md5"


@query(
    with_(ROWS, THIRDS)
    + f"""SELECT 'first' AS state, {TOLD} FROM told WHERE part < 1
UNION ALL SELECT 'second' AS state, {TOLD} FROM told WHERE part < 2
UNION ALL SELECT 'rolled back' AS state, {TOLD} FROM told WHERE source_index <= size + 4
UNION ALL SELECT 'gap' AS state, {TOLD} FROM told WHERE source_index <= size + 4 AND source_index NOT BETWEEN 2 AND 5
UNION ALL SELECT 'restored' AS state, {TOLD} FROM told WHERE part < 2
UNION ALL SELECT 'grown' AS state, {TOLD} FROM told"""
)
def kb_versions(spark, sf):
    """Named states of one knowledge base, without a copy: two of its growth, a
    rollback, a deleted range, the second one restored, and what came later."""
    path = scratch_path(spark, "kb")
    docs = materialize(numbered(spark, sf), "news")
    size = docs.agg(F.ceil(F.count("*") / 3).cast("int")).first()[0]
    names = {}
    for state, parts in (("first", 1), ("second", 2)):
        index.build_kb(docs.filter(F.col("source_index") < parts * size), path, ENCODERS, rows_per_commit=size)
        names[state] = versions.snapshot(spark, path)
    names["rolled back"] = versions.roll_back(spark, path, size + 4)
    names["gap"] = versions.delete_range(spark, path, 2, 5)
    names["restored"] = versions.restore(spark, path, names["second"])
    index.build_kb(docs, path, ENCODERS, rows_per_commit=size)
    names["grown"] = versions.snapshot(spark, path)
    out = None
    for state, version in names.items():
        part = _shown(store.read_kb(spark, path, version=version)).withColumn("state", F.lit(state))
        out = part if out is None else out.unionByName(part)
    return out


def _uneven(spark, sf):
    """A knowledge base whose variants stopped at different documents."""
    docs = chunking.with_document(numbered(spark, sf)).select("source_index", "label", "content")
    full, sliding = chunking.chunk_full(docs), chunking.chunk_sliding(docs)
    parts = [
        full.select("*", F.lit("EMB-A").alias("embedding_model"), F.lit("CHUNK-A").alias("chunking")),
        full.filter("source_index % 5 <> 4").select(
            "*", F.lit("EMB-B").alias("embedding_model"), F.lit("CHUNK-A").alias("chunking")
        ),
        sliding.filter("source_index < 60").select(
            "*", F.lit("EMB-A").alias("embedding_model"), F.lit("CHUNK-B").alias("chunking")
        ),
        sliding.filter("source_index < 70").select(
            "*", F.lit("EMB-B").alias("embedding_model"), F.lit("CHUNK-B").alias("chunking")
        ),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


VARIANTS = [(m, c) for m in ("EMB-A", "EMB-B") for c in ("CHUNK-A", "CHUNK-B")]
UNEVEN = ROWS + """,
uneven AS (
  SELECT * FROM rows WHERE CASE embedding_model || chunking
    WHEN 'EMB-ACHUNK-A' THEN true WHEN 'EMB-BCHUNK-A' THEN source_index % 5 <> 4
    WHEN 'EMB-ACHUNK-B' THEN source_index < 60 ELSE source_index < 70 END),
reached AS (
  SELECT min(m) AS checkpoint FROM
    (SELECT max(source_index) AS m FROM uneven GROUP BY embedding_model, chunking))"""


LISTED = "(VALUES " + ", ".join(f"('{m}', '{c}')" for m, c in VARIANTS) + ")"
MORE = [*VARIANTS, ("EMB-C", "CHUNK-A"), ("EMB-C", "CHUNK-B")]
LISTED_MORE = "(VALUES " + ", ".join(f"('{m}', '{c}')" for m, c in MORE) + ")"


def reached_sql(name: str, listed: str) -> str:
    return f"""SELECT '{name}' AS asked, min(coalesce(m, -1)) AS checkpoint
FROM {listed} v(embedding_model, chunking) LEFT JOIN (
  SELECT embedding_model, chunking, max(source_index) AS m FROM uneven GROUP BY 1, 2)
USING (embedding_model, chunking)"""


@query(
    with_(UNEVEN) + reached_sql("indexed", LISTED) + " UNION ALL " + reached_sql("with a new model", LISTED_MORE)
)
def resume_point(spark, sf):
    """Of the variants that are there, and with a model that has no rows yet."""
    kb = _uneven(spark, sf)
    some = state.index_checkpoint(kb, VARIANTS).withColumn("asked", F.lit("indexed"))
    more = state.index_checkpoint(kb, MORE).withColumn("asked", F.lit("with a new model"))
    return some.unionByName(more).select("asked", "checkpoint")


def prefix_sql(name: str, listed: str) -> str:
    return f"""SELECT '{name}' AS asked, coalesce(min(source_index), (SELECT count(*) FROM news)) - 1 AS prefix
FROM (SELECT source_index FROM news, {listed} v(embedding_model, chunking)
      EXCEPT SELECT source_index FROM (
        SELECT source_index, count(DISTINCT embedding_model || chunking) AS n FROM uneven GROUP BY 1)
      WHERE n = (SELECT count(*) FROM {listed}))"""


@query(
    with_(UNEVEN)
    + prefix_sql("two models", "(VALUES ('EMB-A', 'CHUNK-A'), ('EMB-B', 'CHUNK-A'))").replace(
        "FROM uneven", "FROM uneven WHERE chunking = 'CHUNK-A'"
    )
    + " UNION ALL "
    + prefix_sql("one variant", "(VALUES ('EMB-A', 'CHUNK-A'))").replace(
        "FROM uneven", "FROM uneven WHERE embedding_model || chunking = 'EMB-ACHUNK-A'"
    )
    + " UNION ALL "
    + prefix_sql("with a new model", LISTED_MORE)
)
def common_prefix(spark, sf):
    """How far the variants are without a gap, whatever their last rows are."""
    kb = _uneven(spark, sf)
    asked = {"two models": VARIANTS[::2], "one variant": VARIANTS[:1], "with a new model": MORE}
    out = None
    for name, variants in asked.items():
        part = state.common_prefix(kb, variants).select(F.lit(name).alias("asked"), "prefix")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    with_(UNEVEN) + "SELECT * FROM uneven WHERE source_index <= (SELECT checkpoint FROM reached)"
)
def rolled_back(spark, sf):
    return _shown(index.consistent_kb(_uneven(spark, sf), VARIANTS))


@query(
    with_(UNEVEN) + "SELECT doc_id, source_index FROM news "
    "WHERE source_index > (SELECT checkpoint FROM reached)"
)
def pending_documents(spark, sf):
    point = state.index_checkpoint(_uneven(spark, sf), VARIANTS).first()["checkpoint"]
    return state.pending_documents(numbered(spark, sf), point).select("doc_id", "source_index")


@query(
    with_(UNEVEN) + "SELECT doc_id, source_index FROM news WHERE source_index NOT IN "
    "(SELECT source_index FROM uneven WHERE embedding_model = 'EMB-B' AND chunking = 'CHUNK-A')"
)
def missing_documents(spark, sf):
    kb = _uneven(spark, sf).filter("embedding_model = 'EMB-B' AND chunking = 'CHUNK-A'")
    docs = numbered(spark, sf).select("doc_id", "source_index")
    return state.missing_documents(docs, kb).select("doc_id", "source_index")


RANGES = CHUNKS + f""",
counts AS (SELECT source_index, CAST(ceil(len({words_sql('content')}) / 192) AS INTEGER) AS n_chunks FROM docs),
ranges AS (
  SELECT source_index, n_chunks, CAST(last_id - n_chunks + 1 AS BIGINT) AS first_id, last_id
  FROM (SELECT *, CAST(sum(n_chunks) OVER (ORDER BY source_index) AS BIGINT) AS last_id FROM counts))"""


def _ranges(spark, sf):
    docs = chunking.with_document(numbered(spark, sf)).select("source_index", "content")
    counts = chunking.chunk_counts(docs).select("source_index", "n_chunks")
    return chunking.chunk_id_ranges(counts)


@query(with_(RANGES) + "SELECT source_index, n_chunks, first_id, last_id FROM ranges")
def chunk_id_ranges(spark, sf):
    return _ranges(spark, sf).select("source_index", "n_chunks", "first_id", "last_id")


@query(
    with_(RANGES)
    + """SELECT c.id, r.source_index, md5(c.content) AS content_md5
FROM (SELECT row_number() OVER (ORDER BY source_index, chunk_no) AS id, content FROM chunks) c
JOIN ranges r ON c.id BETWEEN r.first_id AND r.last_id"""
)
def backfill_chunks(spark, sf):
    """Chunks that know only their id get their document back."""
    docs = chunking.with_document(numbered(spark, sf)).select("source_index", "content")
    ranges = _ranges(spark, sf)
    chunks = chunking.chunk_sliding(docs).join(ranges.select("source_index", "first_id"), "source_index")
    nameless = chunks.select((F.col("first_id") + F.col("chunk_no")).alias("id"), "content")
    nameless = nameless.withColumn("source_index", F.lit(None).cast("long"))
    filled = chunking.backfill_source_index(nameless, ranges)
    return filled.select("id", "source_index", F.md5("content").alias("content_md5"))


@query(with_(NEWS) + "SELECT source_index + 1 AS id, source_index FROM news")
def backfill_articles(spark, sf):
    ids = numbered(spark, sf).select((F.col("source_index") + 1).alias("id"))
    return chunking.backfill_full(ids)


@query(with_(ROWS) + "SELECT * FROM rows")
def index_arrivals(spark, sf):
    """The articles arrive as four files and are indexed as a stream."""
    arrivals = scratch_path(spark, "arrivals")
    docs = numbered(spark, sf).select(*NEWS_SCHEMA.names)
    docs.repartition(4, F.col("source_index") % 4).write.parquet(arrivals)
    path = scratch_path(spark, "kb")
    index_stream(
        news_stream(spark, arrivals, 1), path, ENCODERS, scratch_path(spark, "checkpoint")
    ).awaitTermination()
    return _shown(store.read_kb(spark, path))
