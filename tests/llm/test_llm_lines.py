"""Line dedup beside brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from factlake.llm import line_dedup
from factlake.llm.line_dedup import dedup_lines, dedup_report


def slow(rows, threshold=0.8):
    """Line numbers to remove per id, and those without an equal earlier line."""
    seen, gone, near = [], defaultdict(set), defaultdict(set)
    places = sorted(
        {(float("inf") if i is None else i, n, frozenset(line.split()))
         for i, t in rows for n, line in enumerate((t or "").encode().lower().split(b"\n"))},
        key=lambda x: x[:2],
    )
    for i, n, words in places:
        if not words:
            continue
        if any(len(words & s) * (1 + threshold) >= threshold * (len(words) + len(s)) - 1e-9 for s in seen):
            gone[i].add(n)
            if words not in seen:
                near[i].add(n)
        seen.append(words)
    return gone, near


def near_lines(seed, n, length):
    rng = random.Random(seed)
    words = [f"W{i}é" for i in range(40)]
    base = [[rng.choice(words) for _ in range(length)] for _ in range(4)]
    out = []
    for _ in range(n):
        line = list(rng.choice(base))
        for _ in range(rng.randint(0, 1 + length // 5)):
            line[rng.randrange(length)] = rng.choice(words + [f"new{rng.randint(0, 999)}"])
        rng.shuffle(line)
        out.append(" ".join(line))
    return out


def sample():
    rows = [(i, "\n".join(near_lines(i, 12, 3 + i % 25))) for i in range(30)]
    rows += [(40 + i, "\n".join(near_lines(7, 9, 14)[i:])) for i in range(5)]
    rows += [(60, None), (61, ""), (62, " \n\n\t\n"), (63, "De.\nDe.\nde."), (64, "a\r\nA \n\x0ba")]
    rows += [(65, " ".join(f"long{i}" for i in range(20_000))), (66, " ".join(f"long{i}" for i in range(18_000)))]
    return [*rows, (None, "De.\nonly the null id has this line")]


def frame(spark, rows):
    names = "doc_id long, text string, doc string, line string, _doc string, _gone string, n_lines string, words string"
    return spark.createDataFrame([(i, t, "d", "l", "x", "y", "n", "w") for i, t in rows], names).repartition(3)


def check(spark, rows, **options):
    gone, near = slow(rows, options.get("threshold", 0.8))
    got = dedup_report(frame(spark, rows), **options).collect()
    assert len(got) == len(rows)
    for r in got:
        i = float("inf") if r.doc_id is None else r.doc_id
        assert (r.doc_id, set(r.removed_lines)) == (r.doc_id, gone[i])
        if len([j for j, _ in rows if j == r.doc_id]) == 1:
            assert (r.n_removed, r.n_near) == (len(gone[i]), len(near[i]))


@pytest.mark.parametrize("options", [{}, {"closest": 1}, {"threshold": 0.6}, {"threshold": 1.0}])
def test_equal_to_brute_force(spark, options):
    check(spark, sample(), **options)


def test_hot_words_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 5)
    check(spark, sample())


def test_small_groups_of_rows(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    check(spark, sample())


def test_documents_equal_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows[:120])


def test_repeated_rows_share_their_lines(spark):
    rows = [(1, "a b c\nd e f"), (1, "a b c\nd e f"), (2, "a b c\nnew")]
    got = sorted((r.doc_id, r.text) for r in dedup_lines(frame(spark, rows)).collect())
    assert got == [(1, "a b c\nd e f"), (1, "a b c\nd e f"), (2, "new")]


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rows = [
        (None, "said before here\nthe first one's own"), (None, "another text begins\nthe second one's own"),
        (None, "said before here\nequal at one place"), (None, "a third one\nequal at one place"),
        (1, "said before here"), (2, "said before here\nwhat only this says"), (2, "fresh words stand\nsaid before here"),
        (3, "copies of row\nhave one id"), (3, "copies of row\nhave one id"),
        (None, "equal null rows lose it once"), (None, "equal null rows lose it once"),
    ]
    got = sorted((str(r.doc_id), r.text) for r in dedup_lines(frame(spark, rows)).collect())
    ends = ["the first one's own", "another text begins\nthe second one's own", "equal null rows lose it once", ""]
    pair = [["equal at one place", "a third one"], ["", "a third one\nequal at one place"]]
    rest = [("1", "said before here"), ("2", "what only this says"), ("2", "fresh words stand")]
    rest += [("3", "copies of row\nhave one id")] * 2
    assert got in [sorted([*rest, *(("None", t) for t in ends + p)]) for p in pair]
    report = dedup_report(frame(spark, rows)).collect()
    assert len(report) == len(rows) and sum(r.n_removed for r in report) == 6
    assert {r.n_lines for r in report if r.doc_id == 3} == {2}


def test_texts_lose_their_removed_lines(spark):
    rows = sample()
    gone, _ = slow(rows)
    out = dedup_lines(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    texts = {r.doc_id: r.text for r in out.collect()}
    for i, t in rows:
        drop = gone[float("inf") if i is None else i]
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop)
        assert texts[i] == kept


def one_key():
    """Two words with the same 30-bit key."""
    words = [f"rare{i}" for i in range(200_000)]
    keys = (line_dedup.word_hashes(words)[0] >> np.uint64(20)) & np.uint64(line_dedup.HOT - 1)
    order = np.argsort(keys, kind="stable")
    at = int(np.flatnonzero(keys[order][1:] == keys[order][:-1])[0])
    return words[order[at]], words[order[at + 1]]


def test_a_line_is_not_its_own_near_copy(spark):
    common = [f"common{i}" for i in range(8)]
    line = " ".join([*one_key(), *common])
    rows = [(1, line), *((2 + i, f"{w} only{i} here{i}") for i, w in enumerate(common))]
    check(spark, rows)
    assert {r.doc_id: r.text for r in dedup_lines(frame(spark, rows)).collect()}[1] == line
    # its repeat goes, not the first
    check(spark, [*rows, (20, line), (21, line + " more")])


def test_empty_table(spark):
    assert dedup_lines(frame(spark, sample()).limit(0)).collect() == []
    assert dedup_report(frame(spark, sample()).limit(0)).collect() == []


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        dedup_report(frame(spark, sample()), threshold=0.3)


def test_groups_of_templated_lines_stay_small(spark):
    """All lines of a group resemble each other: 32 million pairs, of which a
    group holds each line's nearest only."""
    import resource

    from factlake.llm.line_dedup import PLACE_BITS, _meet

    n, rng = 8_000, np.random.default_rng(1)
    bits = np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    rows = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n)), pa.array(np.full(n, 30)), pa.array(bits.view(np.int64)),
         pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, 5 << PLACE_BITS))],
        names=["doc", "ls", "bits", "bits2", "kp"],
    )
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = pa.Table.from_batches(list(_meet(0.8, 16)(iter([rows]))))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
    y, x = out["y_doc"].to_numpy(), out["x_doc"].to_numpy()
    assert out.num_rows == 16 * (n - 16) + sum(range(16)) and (y > x).all()
    apart = out["apart"].to_numpy()
    for doc in (20, 4000, 7999):
        own = np.bitwise_count(bits[:doc] ^ bits[doc])
        assert sorted(apart[y == doc]) == sorted(own)[:16]
    assert out["more"].to_numpy()[y > 16].all() and not out["more"].to_numpy()[y <= 16].any()
