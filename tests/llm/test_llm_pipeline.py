"""The pipeline beside a brute-force version of its stages, and its contract."""

import os
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from test_llm_lines import slow as slow_lines
from test_llm_leaks import index_of
from test_llm_near_dedup import slow as slow_components

import corpus_pipeline
from factlake.llm.decontaminate import leaks
from factlake.llm.language_id import MIN_SCORE, UNKNOWN, Nearest, grams
from factlake.operators.scale import materialize, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_hand(rows, items):
    """Rows (doc_id, text, lang, ...) to {doc_id: (text, ids)}."""
    learned = Counter()
    for i, text, lang, *_ in rows:
        if i is not None and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            learned.update((lang, g) for g in grams(text or "").tolist())
    profiles = {}
    for lang in {name for name, _ in learned}:
        own = sorted((-n, g) for (name, g), n in learned.items() if name == lang)[:500]
        profiles[lang] = __import__("numpy").array([g for _, g in own])
    nearest = Nearest(profiles, 500)
    said = {i: nearest.predict(t or "") for i, t, *_ in rows}
    docs = {i: t for i, t, *_ in rows if said[i][0] != UNKNOWN and said[i][1] >= MIN_SCORE}
    gone, _ = slow_lines(sorted(docs.items()))
    docs = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in docs.items()}
    docs = {i: docs[i] for i, _, c in slow_components(list(docs.items())) if c == i}
    index = index_of(items, 0.5)
    docs = {i: t for i, t in docs.items() if not leaks([index], [t], 0.5)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return {i: (t, library.encode(t)) for i, t in docs.items()}


def test_run_equals_brute_force(spark, sf):
    read = spark.read.parquet
    rows = [tuple(r) for r in read(f"{sf}/documents.parquet").select(*COLUMNS).collect()]
    items = [tuple(r) for r in read(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    expected = by_hand(rows, items)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: (r.text, r.piece_ids) for r in got} == expected
    assert len(got) == len(expected) and all(r.round_trip for r in got)
    assert all(r.n_chars == len(r.text) and r.n_pieces == len(r.piece_ids) for r in got)


def test_stages_keep_the_columns(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontaminate", "pieces"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, sf), "stage")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out


@pytest.fixture()
def odd_folder(spark, sf):
    """A folder whose tables have nulls, repeats, long texts, extra columns."""

    def make(limit=None):
        path = scratch_path(spark, "odd")
        text = "Thea the ofthstthor nd of ouble edoution wh onharent thinand. " * 3
        rows = [
            (1, text, "en", None, None, "x"), (1, text, "en", None, None, "x"), (2, None, None, "s", 5, None),
            (3, "", "fr", "s", 0, "y"), (None, text + "nd", None, None, 1, "y"), (4, text * 2000, None, "s", 1, "y"),
            (5, "Einverä enpfü enlichzuö erberteach erchge den", "de", "s", 1, "y"), (6, "123 !!", "de", "s", 1, "y"),
            (7, text + "\n\n" + text, "en", "s", 1, "z"),
        ]
        names = "doc_id long, text string, lang string, source string, n_chars long, n_pieces string"
        frame = spark.createDataFrame(rows, names)
        (frame.limit(limit) if limit is not None else frame).write.parquet(f"{path}/documents.parquet")
        items = [(1, None), (2, "x")] if limit is None else []
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        return path

    return make


def test_odd_rows(spark, odd_folder):
    out = corpus_pipeline.run(spark, odd_folder()).collect()
    # the row without an id is empty by then, like 4 and 7, of which the first stays
    assert sorted(str(r.doc_id) for r in out) == ["1", "4", "5"]
    by = {r.doc_id: r for r in out}
    assert by[4].text.strip("\n") == "" or by[4].n_chars == len(by[4].text)


def test_empty_tables(spark, odd_folder):
    out = corpus_pipeline.run(spark, odd_folder(0))
    assert out.collect() == [] and "piece_ids" in out.columns


def test_registered():
    import __spark_entry__ as contract

    names = contract.queries()
    assert "pipeline" in names and "pipeline" not in contract.oracle_sql()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert os.path.exists(corpus_pipeline.__file__)
