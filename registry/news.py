"""Scans, text functions, chunks, positions and samples."""

from __future__ import annotations

import gzip

from pyspark.sql import functions as F

from factlake.functions import text as tx
from factlake.operators import chunking, evaluate, grid, sampling
from factlake.operators.scale import scratch_path
from factlake.sources import news as src
from registry.tables import ARTICLES, NEWS, articles, news, table, with_

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


DOCUMENT = "coalesce(title, '') || chr(10) || chr(10) || coalesce(text, '')"
CONTENT = "coalesce(title, '') || ' ' || coalesce(text, '')"
# DuckDB's \s lacks the vertical tab.
SPACE = r"\s\v\x1c-\x1f"


def clean_sql(c: str) -> str:
    return (
        rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), "
        rf"'http[^{SPACE}]+', '', 'g'), '[^a-z{SPACE}]', '', 'g'), '[{SPACE}]+', ' ', 'g'))"
    )


def words_sql(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '[{SPACE}]+'), lambda w: w <> '')"


def _documents(spark, sf):
    return articles(spark, sf).select(
        "doc_id", tx.compose_document(F.col("title"), F.col("text")).alias("content")
    )


@query(
    with_(NEWS)
    + f"SELECT source_index, title, text, label, split, {CONTENT} AS content "
    "FROM news WHERE split = 'train'"
)
def news_scan(spark, sf):
    """Splits cached on disk once, then one split scanned."""
    numbered = sampling.with_source_index(news(spark, sf), "doc_id")
    path = src.cache_splits(numbered, scratch_path(spark, "news"))
    return src.read_news(spark, path, "train")


@query("SELECT page_id, html || chr(10) AS text FROM pages")
def file_documents(spark, sf):
    """Every page written as one file, then read as documents."""
    path = scratch_path(spark, "files")
    src.write_files(table(spark, sf, "pages").select("page_id", "html"), "page_id", path)
    read = src.read_documents(spark, path, recursive=True)
    page = F.regexp_extract("path", r"page_id=(\d+)", 1).cast("long")
    return read.select(page.alias("page_id"), "text")


@query("SELECT page_id, page_id % 2 = 0 AS packed, html || chr(10) AS text FROM pages")
def decoded_documents(spark, sf):
    """Pages as files of two kinds: plain text, and packed ones, whose suffix
    has a decoder."""
    path = scratch_path(spark, "files")
    pages = table(spark, sf, "pages").select("page_id", "html")
    for kind, rest in (("none", 1), ("gzip", 0)):
        own = pages.filter(F.pmod("page_id", F.lit(2)) == rest)
        src.write_files(own, "page_id", f"{path}/{kind}", kind)
    decoders = {"gz": lambda raw: gzip.decompress(raw).decode("utf-8")}
    read = src.read_documents(spark, path, decoders, recursive=True)
    page = F.regexp_extract("path", r"page_id=(\d+)", 1).cast("long")
    return read.select(page.alias("page_id"), F.endswith("path", F.lit(".gz")).alias("packed"), "text")


@query(with_(ARTICLES) + f"SELECT doc_id, {CONTENT} AS content FROM articles")
def compose_content(spark, sf):
    content = tx.compose_content(F.col("title"), F.col("text"))
    return articles(spark, sf).select("doc_id", content.alias("content"))


@query(with_(ARTICLES) + f"SELECT doc_id, {DOCUMENT} AS content FROM articles")
def compose_document(spark, sf):
    return _documents(spark, sf)


@query(
    with_(ARTICLES) + "SELECT doc_id, CASE WHEN title IS NULL THEN text "
    "ELSE title || chr(10) || chr(10) || text END AS query_text FROM articles"
)
def compose_query(spark, sf):
    text = tx.compose_query(F.col("title"), F.col("text"))
    return articles(spark, sf).select("doc_id", text.alias("query_text"))


@query(with_(NEWS) + "SELECT doc_id, title, text, label FROM news WHERE label = 0")
def fake_news(spark, sf):
    return news(spark, sf).filter(F.col("label") == 0).select("doc_id", "title", "text", "label")


@query(f"SELECT doc_id, {clean_sql('text')} AS content FROM documents")
def clean_documents(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.clean_text(F.col("text")).alias("content")
    )


@query(
    f"SELECT page_id, {clean_sql(chr(39) + ' ' + chr(39) + ' || url || chr(10) || html')} AS content FROM pages"
)
def clean_pages(spark, sf):
    raw = F.concat(F.lit(" "), "url", F.lit("\n"), "html")
    return table(spark, sf, "pages").select("page_id", tx.clean_text(raw).alias("content"))


@query("SELECT doc_id, substr(text, 1, 1000) AS head FROM documents")
def head_chars(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.head_chars(F.col("text")).alias("head"))


@query("SELECT doc_id, replace(text || chr(0) || source, chr(0), '') AS content FROM documents")
def strip_nul(spark, sf):
    raw = F.concat("text", F.lit("\u0000"), "source")
    return table(spark, sf, "documents").select("doc_id", tx.strip_nul(raw).alias("content"))


@query(
    f"SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, array_to_string(w, ' ') AS joined, "
    f"array_to_string(w[11:30], ' ') AS some FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)"
)
def word_split(spark, sf):
    split = table(spark, sf, "documents").select("doc_id", "text", tx.words(F.col("text")).alias("w"))
    return split.select(
        "doc_id",
        F.size("w").alias("n_words"),
        F.array_join("w", " ").alias("joined"),
        tx.rejoin_words(F.col("text"), 10, 20).alias("some"),
    )


@query(
    "SELECT doc_id, CAST(len(t) AS INTEGER) AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5 FROM "
    rf"(SELECT doc_id, regexp_extract_all({clean_sql('text')}, '\b\w\w+\b') AS t FROM documents)"
)
def term_split(spark, sf):
    found = table(spark, sf, "documents").select(
        "doc_id", tx.terms(tx.clean_text(F.col("text"))).alias("t")
    )
    return found.select(
        "doc_id", F.size("t").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("terms_md5")
    )


def sliding_sql(source: str, columns: str) -> str:
    return f"""SELECT {columns}, CAST(s // 192 AS INTEGER) AS chunk_no,
  array_to_string(w[s + 1 : s + 256], ' ') AS content
FROM (SELECT *, unnest(range(0, len(w), 192)) AS s
      FROM (SELECT * EXCLUDE (content), {words_sql('content')} AS w FROM {source}))"""


DOCS = ARTICLES + f",\ndocs AS (SELECT doc_id, {DOCUMENT} AS content FROM articles)"


@query(with_(DOCS) + sliding_sql("docs", "doc_id"))
def sliding_chunks(spark, sf):
    return chunking.chunk_sliding(_documents(spark, sf))


@query(with_(DOCS) + "SELECT doc_id, 0 AS chunk_no, content FROM docs")
def full_chunks(spark, sf):
    return chunking.chunk_full(_documents(spark, sf))


@query(with_(DOCS) + f"SELECT doc_id, CAST(ceil(len({words_sql('content')}) / 192) AS INTEGER) AS n_chunks FROM docs")
def chunk_counts(spark, sf):
    return chunking.chunk_counts(_documents(spark, sf)).select("doc_id", "n_chunks")


@query(with_(NEWS) + "SELECT doc_id, source_index FROM news")
def source_index(spark, sf):
    return sampling.with_source_index(news(spark, sf).select("doc_id"), "doc_id")


@query(with_(NEWS) + "SELECT source_index, source_index // 128 AS batch FROM news")
def index_batches(spark, sf):
    numbered = sampling.with_source_index(news(spark, sf).select("doc_id"), "doc_id")
    return sampling.with_batch(numbered).select("source_index", "batch")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS position FROM documents")
def shuffled_rows(spark, sf):
    return sampling.shuffle_rows(table(spark, sf, "documents").select("doc_id"), "doc_id", ordered=False)


@query("SELECT doc_id, lang, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def random_sample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return sampling.sample_n(docs, 100, "doc_id")


def balanced_sql(n: int) -> str:
    return f"""sample AS (
  SELECT doc_id, label, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS position
  FROM (SELECT doc_id, label, row_number() OVER (
          PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS draw FROM news)
  WHERE draw <= {n})"""


@query(with_(NEWS, balanced_sql(5)) + "SELECT doc_id, label, position FROM sample")
def balanced_sample(spark, sf):
    return sampling.balanced_sample(news(spark, sf).select("doc_id", "label"), 5, "doc_id")


@query(
    """SELECT doc_id, label, draw FROM (
  SELECT doc_id, lang AS label, row_number() OVER (
    PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS draw FROM documents)
WHERE draw <= 20"""
)
def class_sample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"))
    return sampling.class_sample(docs, 20, "doc_id")


@query(with_(NEWS) + "SELECT label, count(*) AS n_rows FROM news GROUP BY label")
def dataset_profile(spark, sf):
    return evaluate.dataset_profile(news(spark, sf))


@query(
    with_(NEWS) + "SELECT doc_id, embedding_model, chunking FROM news, "
    "(VALUES ('EMB-A'), ('EMB-B')) m(embedding_model), (VALUES ('CHUNK-A'), ('CHUNK-B')) c(chunking)"
)
def index_variants(spark, sf):
    return grid.index_variants(news(spark, sf).select("doc_id"))
