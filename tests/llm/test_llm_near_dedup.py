"""SimHash, covering masks and components beside brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from factlake.llm import line_dedup
from factlake.llm import near_dedup
from factlake.llm.near_dedup import (
    components, covering_masks, fingerprint,  links_within, local_links, near_duplicates, one_of_each, shingle_hashes,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow(rows):
    """(id, text) rows to (id, fingerprint, component) rows."""
    prints = [(i, slow_print(t)) for i, t in rows]
    known = [(i, f) for i, f in prints if i is not None]
    linked = [
        (a, b) for k, (a, f) in enumerate(known) for b, g in known[:k] if (f ^ g).bit_count() <= 4
    ]
    of = slow_components({i for i, _ in known}, linked)
    return sorted(((i, f"{f:016x}", of.get(i)) for i, f in prints), key=repr)


def fast(df):
    return sorted((tuple(r) for r in near_duplicates(df).collect()), key=repr)


def edge_rows():
    rng = random.Random(3)
    words = ["Ab", "cd", "é", "efg", "hij", "klm", "no", "中文"]
    base = [rng.choice(words) + str(rng.randint(0, 99)) for _ in range(300)]
    rows = []
    for n in range(60):
        copy = list(base)
        for _ in range(n // 6):
            copy[rng.randrange(len(copy))] = "x"
        rows.append((n * 7 % 61, " ".join(copy)))
    rows += [(100 + n, " ".join(rng.choice(words) for _ in range(n))) for n in range(12)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "A B"), (204, "a\x0bb"), (205, "a\xa0b")]
    rows += [(206, "word " * 20_000), (None, " ".join(base)), (None, None)]
    rows += [rows[0], rows[0], (3, "another text of the same document"), (1, None)]
    return rows


def test_small_rows_equal_brute_force(spark):
    rows = edge_rows()
    frame = spark.createDataFrame(
        [(i, t, "f", 1, "a") for i, t in rows], "doc_id long, text string, fp string, component_id int, _text string"
    )
    assert fast(frame) == slow(rows)


def test_documents_equal_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert fast(df) == slow([tuple(r) for r in df.collect()])


def test_empty_table(spark):
    assert fast(spark.createDataFrame([], "doc_id long, text string")) == []


def test_prints_count_the_majority():
    assert fingerprint(np.zeros(0, np.uint64)) == 0
    assert fingerprint(np.array([1, 2], np.uint64)) == 0
    assert fingerprint(np.array([(1 << 64) - 1, 1 << 63, 1], np.uint64)) == (1 | 1 << 63) - (1 << 64)
    assert len(shingle_hashes("a b c")) == 1 and len(shingle_hashes("a b c d e")) == 2


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_every_close_pair_collides(radius):
    masks = covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(3000):
        apart = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(apart & m == 0 for m in masks)


def close_values(rng, n):
    base = [rng.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        v = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, 7)):
            v ^= 1 << b
        out.add(v - (1 << 64) if v >> 63 else v)
    return sorted(out)


@pytest.mark.parametrize("block", [10_000, 7])
def test_links_have_all_components(spark, block):
    values = close_values(random.Random(block), 400)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    linked = [(r.a, r.b) for r in links_within(frame, block=block).collect()]
    u = [v & (1 << 64) - 1 for v in values]
    pairs = [(values[i], values[j]) for i in range(400) for j in range(i) if (u[i] ^ u[j]).bit_count() <= 4]
    assert slow_components(values, linked) == slow_components(values, pairs)


def test_two_blocks_meet_without_their_own_pairs():
    values = np.array([0, 1, 3, 7], np.int64)
    assert len(set(local_links(values, 1))) == 1
    # only pairs between {0, 1} and {3, 7}
    assert len(set(local_links(values, 1, left=2))) == 3


def test_chains_and_stars_become_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5000, 4999), (7, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.root for r in found.collect()}
    expected = {n: r for n, r in slow_components({x for e in edges for x in e}, edges).items() if n != r}
    assert got == expected


def test_one_document_of_each_component_stays(spark):
    """Rows without an id, and different texts of one id, are documents."""
    from hashlib import md5

    def order(row):
        return (row[0] is None, row[0] or 0, md5((row[1] or "").encode()).hexdigest())

    fox, law = "the quick brown fox jumps over the lazy dog " * 3, "tax law of the year says that all income counts " * 3
    rows = edge_rows() + [(7000, fox), (7000, law), (7000, law), (None, law + "twice"), (None, "alone here"), (None, None)]
    frame = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, _doc string")
    documents = [r for r in rows if r[0] is None] + list({r for r in rows if r[0] is not None})
    documents = sorted(documents, key=order)
    found = slow([(n, t) for n, (_, t) in enumerate(documents)])
    expected = sorted((documents[n] for n, _, c in found if n == c), key=str)
    assert len(expected) < len(documents) and (7000, fox) in expected and (None, "alone here") in expected
    for part in (3, 5):
        kept = one_of_each(frame.repartition(part))
        assert kept.columns == frame.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == expected
    assert near_dedup.RADIUS == 4


def test_no_pair_of_kept_documents_is_similar(spark):
    import corpus_pipeline

    rng = random.Random(3)
    rows = []
    for i in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 30, 300]))]
        for k in range(4):
            words = list(base)
            for _ in range(k * len(base) // 100):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            rows.append((4 * i + k, "\n".join(" ".join(words[a : a + 7]) for a in range(0, len(words), 7))))
    rows += [(900, ""), (None, max((t for _, t in rows), key=len) + " more")]

    def runs(text):
        words = text.lower().split()
        return {tuple(words[a : a + 5]) for a in range(max(len(words) - 4, 1))} if words else set()

    def like(a, b):
        return len(a & b) >= 0.8 * len(a | b) - 1e-9

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    first = {r.doc_id: runs(r.text) for r in one_of_each(df).collect() if r.text}
    expected = {i for i, a in first.items() if i is not None and not any(j is not None and j < i and like(a, b) for j, b in first.items())}
    assert expected != set(first)
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert sorted(i for i in got if i not in (None, 900)) == sorted(i for i in expected if i is not None)
    assert None not in got and 900 in got


def test_whole_sets_are_sent_of_similar_texts_only(spark, monkeypatch):
    """Long texts that share a passage meet, but their sketches tell them apart."""
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(200)]
    texts = [" ".join([f"w{i}" for i in rng.integers(0, 10**9, 600)] + passage) for _ in range(30)]
    texts += [texts[4] + " and more", "x " + texts[9], texts[9] + " y"]
    sent, plain = [], line_dedup.word_sets

    def counted(texts, wanted, run_words=1, sketch=False):
        if not sketch:
            sent.append(wanted.count())
        return plain(texts, wanted, run_words, sketch=sketch)

    monkeypatch.setattr(line_dedup, "word_sets", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc bigint, _text string")
    _, removed = line_dedup.removed_lines(docs, 0.8, run_words=5)
    assert {r["doc"] for r in removed.collect()} == {30, 31, 32}
    assert sum(sent) < 15


def test_sketches_differ_in_no_more_bits_than_sets_in_words():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 2**63, 900).astype(np.uint64)
    sets = [np.concatenate([common, rng.integers(0, 2**63, n).astype(np.uint64)]) for n in (1, 40, 400, 5000)]
    sizes = np.array([len(s) for s in sets])
    bits = [np.frombuffer(b, np.uint64) for b in line_dedup.sketches_of(sizes, np.concatenate(sets))]
    for i in range(4):
        for j in range(4):
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum()
            assert apart <= (sizes[i] + sizes[j] - 1800 if i != j else 0)
