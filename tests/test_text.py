"""Text functions against plain Python, on rows that are easy to get wrong."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factlake.functions import prompt as pr
from factlake.functions import text as tx
from factlake.operators.chunking import chunk_counts, chunk_sliding, with_document
from factlake.operators.features import term_counts

TEXTS = [
    "",
    " \t\n ",
    "one",
    "a b c　d",
    "a\x1cb\x1dc\x1ed\x1fe\x85f",
    "See http://x.y/z?q=1 now HTTPS://Q",
    "whttp://glued end",
    "http",
    "{query} and {context} {0}",
    "İstanbul K été it's 42",
    "tab\vvertical\fform",
    "http://a b\x1cc rest",
    "a" * 1001,
    "\U0001f600" * 1001,
]


def python_clean(t):
    t = re.sub(r"http\S+", "", t.lower())
    t = re.sub(r"[^a-z\s]", "", t)
    return re.sub(r"\s+", " ", t).strip()


def python_chunks(t, size=256, overlap=64):
    w = t.split()
    return [" ".join(w[i : i + size]) for i in range(0, len(w), size - overlap)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string")


def values(df):
    return [r[1] for r in sorted(df.collect())]


def test_clean_and_words(spark):
    df = frame(spark, TEXTS)
    assert values(df.select("id", tx.clean_text(F.col("t")))) == [python_clean(t) for t in TEXTS]
    assert values(df.select("id", tx.words(F.col("t")))) == [t.split() for t in TEXTS]
    assert values(df.select("id", tx.head_chars(F.col("t")))) == [t[:1000] for t in TEXTS]
    found = values(df.select("id", tx.terms(F.lower("t"))))
    assert found == [re.findall(r"(?u)\b\w\w+\b", t.lower()) for t in TEXTS]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("aZ h/t:p \x1c\n9é ."), max_size=60), min_size=1, max_size=40))
def test_random_texts(spark, texts):
    df = frame(spark, texts)
    assert values(df.select("id", tx.clean_text(F.col("t")))) == [python_clean(t) for t in texts]
    assert values(df.select("id", tx.words(F.col("t")))) == [t.split() for t in texts]


@pytest.mark.parametrize("size,overlap", [(256, 64), (4, 1), (3, 0)])
def test_chunks(spark, size, overlap):
    texts = TEXTS + [" ".join(map(str, range(n))) for n in (191, 192, 193, 250, 256, 257, 449)]
    df = frame(spark, texts).withColumnRenamed("t", "content")
    rows = chunk_sliding(df, size, overlap).collect()
    got = sorted((r["id"], r["chunk_no"], r["content"]) for r in rows)
    want = [
        (i, n, c) for i, t in enumerate(texts) for n, c in enumerate(python_chunks(t, size, overlap))
    ]
    assert got == want
    counts = {r["id"]: r["n_chunks"] for r in chunk_counts(df, size, overlap).collect()}
    assert counts == {i: len(python_chunks(t, size, overlap)) for i, t in enumerate(texts)}


def test_overlap_must_be_smaller_than_size():
    with pytest.raises(ValueError):
        tx.sliding_windows(F.lit("a"), 64, 64)


def test_null_title_and_text(spark):
    rows = [(None, "b"), ("a", None), (None, None), ("a", "b")]
    df = spark.createDataFrame(rows, "title string, text string")
    got = df.select(
        tx.compose_content(F.col("title"), F.col("text")),
        tx.compose_query(F.col("title"), F.col("text")),
    ).collect()
    assert [tuple(r) for r in got] == [(" b", "b"), ("a ", None), (" ", None), ("a b", "a\n\nb")]
    documents = with_document(df).select("content").collect()
    assert [r[0] for r in documents] == ["\n\nb", "a\n\n", "\n\n", "a\n\nb"]


def test_term_counts_in_the_row(spark):
    df = spark.createDataFrame([(1, "bb aa bb cc bb"), (2, "x"), (3, "dd")], "doc_id int, content string")
    assert sorted(tuple(r) for r in term_counts(df).collect()) == [
        (1, "aa", 1), (1, "bb", 3), (1, "cc", 1), (3, "dd", 1),
    ]


def test_prompt_is_filled_once(spark):
    df = spark.createDataFrame([(["x {query}", "y"], "news {context}")], "docs array<string>, q string")
    prompt = df.select(pr.fill_prompt(pr.build_context(F.col("docs")), F.col("q"))).first()[0]
    want = pr.USER_PROMPT.format(context="[1] x {query}\n\n[2] y", query="news {context}")
    assert prompt == want


def test_budget_and_duration(spark):
    cases = [(10, "full", 8192), (3, "full", 8192), (1, "sliding", 8192), (1, "sliding", 1000)]
    df = spark.createDataFrame(cases, "k int, kind string, cap int")
    got = df.select(
        pr.context_budget(F.col("k"), F.col("kind"), F.col("cap")),
        pr.context_overflow(F.col("k"), F.col("kind"), F.col("cap")),
    ).collect()
    assert [tuple(r) for r in got] == [(8192, True), (5120, False), (2048, False), (1000, True)]
    times = spark.createDataFrame([(0.4,), (59.99,), (60.0,), (3725.5,)], "s double")
    shown = [r[0] for r in times.select(pr.format_duration(F.col("s"))).collect()]
    assert shown == ["0m0s", "0m59s", "1m0s", "62m5s"]


def test_documents_as_json(spark):
    import json

    df = spark.sql(
        """select array(named_struct('content', 'a "b"\\nc', 'label', 1, 'distance', 0.25D),
           named_struct('content', 'é', 'label', 0, 'distance', cast(null as double))) docs"""
    )
    shown = df.select(pr.docs_json(F.col("docs"))).first()[0]
    assert json.loads(shown) == [['a "b"\nc', 1, 0.25], ["é", 0, None]]
