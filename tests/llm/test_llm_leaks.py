"""Decontamination: retrieval and verification beside brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from factlake.llm import decontaminate
from factlake.llm.decontaminate import (
    B, K1, Index, drop_leaks, find_leaks, length_class, question_and_answer, terms,
)


def items_and_texts(seed, n_items=40, n_texts=60):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, pick(rng.randint(6, 60))) for i in range(n_items)]
    texts = []
    for _ in range(n_texts):
        text = pick(rng.randint(0, 400))
        if rng.random() < 0.5:
            text += " " + rng.choice(items)[1] + " " + pick(rng.randint(0, 90))
        texts.append(text)
    return items, texts


def index_of(items, threshold):
    parts = [question_and_answer(t) for _, t in items]
    counts = [Counter(q + a) for q, a in parts]
    df = Counter(t for c in counts for t in c)
    parsed = [(i, c, q, a) for (i, _), c, (q, a) in zip(items, counts, parts)]
    return Index(parsed, df, len(items), sum(sum(c.values()) for c in counts) / len(items), threshold)


def slow_scores(items, text):
    """BM25 of every item for one passage, divided by the item's own."""
    own = [terms(t) for _, t in items]
    df = Counter(t for w in own for t in set(w))
    mean = sum(map(len, own)) / len(own)
    out = []
    for w in own:
        counts = Counter(w)
        norm = K1 * (1 - B + B * len(w) / mean)
        weight = {
            t: np.log(1 + (len(own) - df[t] + 0.5) / (df[t] + 0.5)) * k * (K1 + 1) / (k + norm) for t, k in counts.items()
        }
        out.append(sum(x for t, x in weight.items() if t in text) / sum(weight.values()))
    return out


@pytest.mark.parametrize("threshold", [0.15, 0.3, 0.5, 0.9])
def test_everything_above_the_threshold_is_found(threshold):
    items, texts = items_and_texts(int(threshold * 100))
    index = index_of(items, threshold)
    words = [terms(t) for t in texts]
    counts = np.array([len(w) for w in words])
    found = np.array([index.at.get(w, -1) for ws in words for w in ws], np.int64)
    got = {(a, b, i): s for a, b, i, s in zip(*(x.tolist() for x in index.search(found, counts)))}
    expected = {}
    for k, own in enumerate(words):
        for j in range(max(1, -(-len(own) // index.half) - 1)):
            passage = set(own[j * index.half : (j + 2) * index.half])
            for i, s in enumerate(slow_scores(items, passage)):
                if s >= threshold:
                    expected[k, j * index.half, i] = s
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_question_and_answer():
    assert question_and_answer("What is it? It is a cat.") == (["what", "is", "it"], ["it", "is", "a", "cat"])
    assert question_and_answer("one two\nthree") == (["one", "two"], ["three"])
    assert question_and_answer("a b c d e") == (["a", "b"], ["c", "d", "e"])
    assert question_and_answer("ends here?") == (["ends"], ["here"])
    assert [length_class(n) for n in (1, 64, 65, 128, 129)] == [64, 64, 128, 128, 256]


def frames(spark):
    question = "which of the seven old bridges over the river was built first by the monks?"
    answer = "the northern one was built in the year ten eighty by monks from the hill"
    filler = " ".join(f"filler{i}" for i in range(700))
    long_item = " ".join(f"rare{i}" for i in range(900))
    items = [
        (1, f"{question} {answer}"), (2, None), (3, ""), (4, "too short"), (None, "an item without any id is used as well"),
        (5, f"{question} {answer}"), (6, long_item), (7, "alpha beta gamma delta epsilon zeta eta theta"),
    ]
    texts = [
        (1, f"{filler} {question.upper()} {answer}! {filler}"), (2, question), (3, answer), (4, None), (5, ""),
        (6, filler), (7, f"{filler} {long_item} {filler}"), (8, " ".join(f"rare{i}" for i in range(300))),
        (None, f"{question} {answer}"), (9, f"{question} {answer}"), (9, f"{question} {answer}"),
        (10, f"{question} well, you see, {answer}"), (11, "too short"), (12, "alpha beta gamma delta epsilon zeta eta theta"),
        (13, f"{filler} an item without any id is used as well"), (14, "short too"), (15, "too very short"),
    ]
    docs = spark.createDataFrame(
        [(i, t, "s", 0.5, "x") for i, t in texts], "doc_id long, text string, item_id string, score double, _text string"
    )
    return docs.repartition(2), spark.createDataFrame(items, "item_id long, text string")


LEAKS = [
    (1, 1), (1, 5), (7, 6), (9, 1), (9, 1), (9, 5), (9, 5), (10, 1), (10, 5), (11, 4), (12, 7),
    (None, 1), (None, 5), (13, None),
]


@pytest.mark.parametrize("group_words", [400_000, 30, 3])
def test_edge_rows(spark, group_words):
    docs, items = frames(spark)
    got = find_leaks(docs, items, group_words=group_words)
    assert got.columns == ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.item_id) for r in rows), key=str) == sorted(LEAKS, key=str)
    assert all(0.5 <= r.score <= 1 and r.question_overlap >= 0.5 and r.answer_overlap >= 0.5 for r in rows)
    kept = drop_leaks(docs, items, group_words=group_words)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 6, 8, 14, 15]


def slow_leaks(items, texts, threshold=0.5, least=0.5):
    """Every window of every text against every item, word by word."""
    out = {}
    for d, text in texts:
        own = terms(text)
        for n, (i, item) in enumerate(items):
            if not (words := terms(item)):
                continue
            half = length_class(len(words))
            for j in range(max(1, -(-len(own) // half) - 1)):
                passage = own[j * half : (j + 2) * half]
                score = slow_scores([x for x in items if terms(x[1])], set(passage))[[x for x in items if terms(x[1])].index((i, item))]
                if score < threshold - 1e-9:
                    continue
                parts = [list(words)] if len(words) < 5 else question_and_answer(item)
                shares = []
                for part in parts:
                    size = len(part) if len(words) < 5 else min(5, len(part))
                    has = {tuple(passage[k : k + size]) for k in range(len(passage) - size + 1)}
                    runs = [tuple(part[k : k + size]) for k in range(len(part) - size + 1)]
                    shares.append(sum(r in has for r in runs) / len(runs))
                if min(shares) >= least:
                    row = (round(min(score, 1.0), 6), shares[0], shares[-1])
                    out[d, i] = max(row, out.get((d, i), row))
    return out


def test_short_items_and_any_grouping(spark):
    """Items of 1 to 4 words, and scores that groups do not change."""
    rng = random.Random(9)
    items, texts = items_and_texts(9, 25, 30)
    items = items + [(100 + n, " ".join(rng.choice(texts[k][:900].split() or ["x"]) for k in range(n))) for n in (1, 2, 2, 3, 4)]
    items = [(k, t) for k, (_, t) in enumerate(items)]
    items += [(200, "Capital of Peru? Lima"), (201, "deep sea"), (202, "?!")]
    texts = list(enumerate(texts)) + [(90, "the capital of peru lima is"), (91, "lima capital of peru"), (92, "deep blue sea"), (93, "Deep, sea")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = slow_leaks(items, texts)
    assert {(90, 200), (93, 201)} <= expected.keys() and not {(91, 200), (92, 201)} & expected.keys()
    for group_words in (400_000, 60):
        rows = find_leaks(docs, bench, group_words=group_words).collect()
        got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in rows}
        assert got.keys() == expected.keys() and len(rows) == len(got)
        assert all(got[k] == pytest.approx(expected[k], abs=1e-6) for k in got)


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert find_leaks(docs.limit(0), items).collect() == []
    assert find_leaks(docs, items.limit(0)).collect() == []
    assert drop_leaks(docs, items.limit(0)).count() == docs.count()


def test_planted_passages_are_found(spark, sf):
    import duckdb

    expected = duckdb.sql(
        f"SELECT doc_id, item_id FROM '{sf}/documents.parquet' d JOIN '{sf}/benchmark.parquet' b ON contains(d.text, b.text)"
    ).fetchall()
    read = spark.read.parquet
    got = find_leaks(read(f"{sf}/documents.parquet"), read(f"{sf}/benchmark.parquet"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == sorted(expected)
    assert decontaminate.THRESHOLD == 0.5
