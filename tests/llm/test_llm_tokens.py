"""Token counts, piece ids and token files beside the libraries they stand for."""

import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factlake.llm import token_files
from factlake.llm.piece_codec import PieceCodec, add_pieces, codec, decode_pieces, encode_pieces
from factlake.llm.token_counts import MergeTable, count_tokens, counter
from factlake.llm.token_files import Codes, digest, encoder, pack, read_documents, token_path, write_tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXT = st.text(st.one_of(st.sampled_from("aeinorst  \n\t.,'!19é中"), st.characters(codec="utf-8")), max_size=60)
EDGES = [
    "", " ", "\n", "a", "x<|endoftext|> y<|endoftext|>", "<|startoftext|>A", "don't DON'T !!'s",
    "a" * 3000, " " * 2000, "ab" * 1500, "é" * 999, "\x1c\x85\xa0 　x", "αbc abc123 12,5",
    "é ≮ ĳ", "ªºµ", "".join(random.Random(1).choice("etaoinshr") for _ in range(5000)),
]


@pytest.fixture(scope="module")
def texts(sf):
    import duckdb

    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet'").fetchall()] + EDGES


def library(path):
    return Tokenizer.from_file(path)


def test_counts_equal_the_library(texts):
    expected = [len(e) for e in library(BYTES).encode_batch_fast(texts, add_special_tokens=False)]
    assert counter(BYTES).count(texts).tolist() == expected


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_any_text_counts_like_the_library(text):
    assert counter(BYTES).count([text])[0] == len(library_bytes.encode(text, add_special_tokens=False))


library_bytes = library(BYTES)
library_words = library(WORDS)
library_pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_merges_that_outrank_their_parts_go_one_by_one():
    base = np.arange(256)
    a, b = 97, 98
    # bb -> 300 after b(bb) -> 301 was ranked first
    table = MergeTable(base, np.array([300, b]), np.array([b, b]), np.array([301, 300]))
    assert not table.all_at_once
    assert table.counts([b"bbbb", b"", b"a", b"bbb"]).tolist() == [2, 0, 1, 1]
    assert a not in table.made


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_any_text_gets_the_pieces_of_the_library(text):
    ids, counts = codec(PIECES).encode([text])
    assert ids.tolist() == library_pieces.encode(text)
    assert codec(PIECES).decode(ids, counts) == [library_pieces.decode(ids.tolist())]


def test_pieces_equal_the_library(texts):
    ids, counts = codec(PIECES).encode(texts)
    expected = library_pieces.encode(texts)
    assert ids.tolist() == [i for e in expected for i in e]
    assert counts.tolist() == [len(e) for e in expected]
    assert codec(PIECES).decode(ids, counts) == texts


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_any_text_gets_the_word_ids_of_the_library(text):
    ids, counts = encoder(WORDS).encode([text])
    assert ids.tolist() == library_words.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_get_whole_texts(texts):
    ids, counts = encoder(BYTES).encode(texts[:40])
    expected = [library_bytes.encode(t, add_special_tokens=False).ids for t in texts[:40]]
    assert not encoder(BYTES).by_word and ids.tolist() == [i for e in expected for i in e]


def test_unit_table_starts_anew():
    from factlake.llm.texts import UnitTable

    table = UnitTable(lambda units: (np.arange(len(units)), np.ones(len(units), int)), max_units=3)
    for words in (["a", "b"], ["c", "d", "a"], ["x" * 500], []):
        at, counts = table.find([words, []])
        assert counts.tolist() == [len(words), 0] and len(table.ids(at)) == len(words)
        assert len(table._at) <= 3


@pytest.mark.parametrize("top", [1, 200, 50_000, 1 << 24, 1 << 32])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_give_any_token(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n)
    codes = Codes(pack(ids))
    assert len(codes) == n and codes.span(0, n).tolist() == ids.tolist()
    places = rng.integers(0, n, 50) if n else np.zeros(0, int)
    assert codes.get(places).tolist() == ids[places].tolist()
    for _ in range(20):
        lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
        assert codes.span(lo, hi).tolist() == ids[lo:hi].tolist()
    with pytest.raises(IndexError):
        codes.get(np.array([n]))


EXTRA = "doc_id long, text string, n_tokens string, start string, _text string, n_pieces string, ids string"


def edge_frame(spark):
    texts = [*EDGES, None, "twice", "twice"]
    ids = [*range(len(texts) - 1, 0, -1), None]
    rows = [(i, t, "x", None, "y", "z", None) for i, t in zip(ids, texts)]
    return spark.createDataFrame([*rows, rows[0], rows[2]], EXTRA).repartition(3)


def test_counts_of_edge_rows(spark):
    got = sorted((r.n_bytes, r.n_tokens) for r in count_tokens(edge_frame(spark), BYTES).collect())
    texts = [r.text or "" for r in edge_frame(spark).collect()]
    expected = [(len(t.encode()), len(library_bytes.encode(t, add_special_tokens=False))) for t in texts]
    assert got == sorted(expected)
    assert count_tokens(edge_frame(spark).limit(0), BYTES).collect() == []


def test_pieces_of_edge_rows(spark):
    frame = edge_frame(spark)
    out = add_pieces(frame, PIECES)
    assert out.columns == ["doc_id", "text", "n_tokens", "start", "_text", "ids", "n_pieces", "piece_ids", "round_trip"]
    for r in out.collect():
        assert r.round_trip and r.piece_ids == library_pieces.encode(r.text or "")
        assert r.n_pieces == len(r.piece_ids)
    back = decode_pieces(encode_pieces(frame, PIECES), PIECES)
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in frame.collect())
    assert add_pieces(frame.limit(0), PIECES).collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id long, piece_ids array<int>")
    assert [r.text for r in decode_pieces(nothing, PIECES).collect()] == [""]


@pytest.mark.parametrize("segment", [40, 1 << 20])
def test_token_files_of_edge_rows(spark, segment):
    frame = edge_frame(spark)
    path = token_path(spark)
    write_tokens(frame, path, WORDS, 2, segment_tokens=segment)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in frame.collect()))
    start, expected = 0, []
    for known, doc, text in rows:
        ids = [*library_words.encode(text, add_special_tokens=False).ids, 2]
        raw = np.array(ids, "<u4").tobytes()
        expected.append((doc if known else None, start, len(ids), crc32(raw), ids))
        start += len(ids)
    got = {r.start: r for r in digest(spark, path).collect()}
    assert [tuple(got[e[1]]) for e in expected] == [e[:4] for e in expected]
    found = {r.start: r.ids for r in read_documents(spark, path).collect()}
    assert [found[e[1]] for e in expected] == [e[4] for e in expected]
    if segment == 40:
        assert token_files.read_segments(spark, path).count() > 3


def test_half_of_all_rows_without_an_id(spark):
    rows = [(None if i % 2 else i, f"text {i * 7919 % 1000:03d} of many") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = []
    for limit in (10_000, 50):
        path = token_path(spark)
        write_tokens(frame, path, WORDS, 2, rows_per_key=limit)
        found.append(sorted(digest(spark, path).collect(), key=lambda r: r.start))
        shards = token_files.read_segments(spark, path).groupBy("shard").agg({"n_tokens": "sum"}).collect()
        share = max(r[1] for r in shards) / sum(r[1] for r in shards)
        assert share > 0.45 if limit == 10_000 else share < 0.4
    assert found[0] == found[1]


def test_token_files_of_nothing(spark):
    path = token_path(spark)
    write_tokens(edge_frame(spark).limit(0), path, WORDS, 2)
    assert digest(spark, path).collect() == []


def test_limit_column(spark, sf):
    from factlake.llm.queries import QUERIES

    out = QUERIES["op1_token_counts"](spark, sf)
    assert out.filter(F.col("over_limit") != (F.col("n_tokens") > 1024)).isEmpty()


def test_pairs_of_pieces_are_asked_for_once(monkeypatch):
    """CHECK op6_piece_codec: forgotten units don't take their pieces apart again."""
    own = PieceCodec(PIECES, remembered=10)
    asked, follows = [], own.follows
    monkeypatch.setattr(own, "follows", lambda a, b: (asked.append(len(a)), follows(a, b))[1])
    parts = ["re", "na", "tion", "ing", "über", "каз", "ment", "or", "st", "中"]
    texts = [" ".join(a + b + c for c in parts) for a in parts for b in parts]
    pairs = []
    for _ in range(2):
        ids, counts = own.encode(texts)
        assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == library_pieces.encode(texts)
        pairs.append(sum(asked))
    assert pairs[0] and pairs[1] - pairs[0] < pairs[0] / 10
