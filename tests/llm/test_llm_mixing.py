"""Mixing against seats given out one after the other."""

import heapq
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factlake.llm.mixing import PRIMES, apportion, count_words, mix, mixed_texts, taken_words, with_targets
from factlake.llm.queries import op12_source_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_seats(votes, seats):
    """Highest quotients from a heap; equal ones go to the first party."""
    heap = [(-v, p, 1) for p, v in sorted(votes.items()) if v > 0]
    heapq.heapify(heap)
    quota = dict.fromkeys(votes, 0)
    for _ in range(seats):
        if not heap:
            break
        _, party, k = heapq.heappop(heap)
        quota[party] += 1
        heapq.heappush(heap, (-votes[party] / (2 * k + 1), party, k + 1))
    return quota


def slow_targets(sizes, weights=(5, 2, 1), ceiling=3):
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(ceiling * sizes[n] for n in capped)
        left = sum(weight[n] for n in names if n not in capped)
        for n in names:
            target[n] = ceiling * sizes[n] if n in capped else weight[n] * rest / left
        above = {n for n in names if n not in capped and target[n] > ceiling * sizes[n]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("seed", range(4))
def test_seats_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    votes, seats = {}, {}
    for g in range(12):
        n = rng.choice([1, 2, 5, 40])
        scale = rng.choice([1, 3, 1000])
        votes[g] = {p: float(rng.choice([0, 1, 1, 2, rng.randint(1, scale)])) for p in range(n)}
        seats[g] = rng.choice([0, 1, 3, n // 2, n, 7 * n, 500]) if any(votes[g].values()) else 0
    parties = spark.createDataFrame([(g, p, v) for g in votes for p, v in votes[g].items()], "grp int, party int, votes double")
    groups = spark.createDataFrame(list(seats.items()), "grp int, seats long")
    found = defaultdict(dict)
    for r in apportion(parties.repartition(3), groups).collect():
        found[r.grp][r.party] = r.quota
    assert found == {g: slow_seats(votes[g], seats[g]) for g in votes}


@pytest.mark.parametrize("seed", range(3))
def test_targets_equal_resharing(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "ä", "😀"] + [f"s{i}" for i in range(rng.choice([1, 20]))]
    sizes = {n: rng.choice([0, 1, 10, 100, 10_000]) for n in names} | {"s0": 50}
    frame = spark.createDataFrame(list(sizes.items()), "name string, size long")
    frame = frame.withColumn("src", F.coalesce(F.concat(F.lit("+"), "name"), F.lit("~")))
    found = {r.name: r.target for r in with_targets(frame, (5, 2, 1), 3).collect()}
    assert found == pytest.approx(slow_targets(sizes))


def checked(spark, rows, **how):
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, size string, _start int, shard int")
    mixed = mix(frame.repartition(4), count_words(F.col("text")), keep=["text", "source", "_start"], **how)
    mixed = mixed.withColumn("taken", taken_words())
    out = mixed.collect()
    assert len(out) == len(rows)
    sizes, source_sizes, taken = [len(WORD.findall(r[2] or "")) for r in rows], defaultdict(int), defaultdict(int)
    for r, n in zip(rows, sizes):
        source_sizes[r[1]] += n
    assert sorted(r["size"] for r in out) == sorted(sizes)
    target = slow_targets(source_sizes)
    for r in out:
        assert r["size"] == len(WORD.findall(r.text or ""))
        assert r.source_size == source_sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r["size"] and all(1 <= p.times <= 3 for p in r.pieces)
        taken[r.source] += r.taken
    block = how.get("block", 16)
    shards = {(r.source, r.shard) for r in out if r.shard is not None}
    for s in target:
        slack = block * (1 + 0.5 * sum(x[0] == s for x in shards))
        assert abs(taken[s] - target[s]) <= slack, (s, taken[s], target[s])
    return mixed


def corpus(n, seed=3):
    rng = random.Random(seed)
    names = ["hot"] * 20 + ["a", "b", None, "c", "tiny", ""]
    rows = []
    for i in range(n):
        words = " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([0, 1, 5, 40, 300])))
        rows.append((i, rng.choice(names), rng.choice([words, words, words + "\n x\t", None]), "s", 1, 2))
    return rows


def test_words_come_near_targets_and_are_the_texts_words(spark):
    rows = corpus(500) + [(900, "tiny", "one two three", "s", 1, 2)]
    mixed = checked(spark, rows, block=8, shard_words=2000)
    texts = mixed_texts(mixed).collect()
    taken = defaultdict(int)
    for t in texts:
        taken[t.doc_id] += len(WORD.findall(t.words))
    assert {r.doc_id: r.taken for r in mixed.collect() if r.taken} == dict(taken)
    # every word of a document is taken as often as its block
    for r in [r for r in mixed.collect() if r["size"] and r.taken == 3 * r["size"]][:20]:
        own = sorted(w for t in texts if t.doc_id == r.doc_id for w in t.words.split(" "))
        assert own == sorted(WORD.findall(r.text) * 3)


def test_one_id_no_words_long_texts_no_rows(spark):
    rows = [(None, "a", f"w{i} x", "s", 1, 2) for i in range(200)] + [(7, "a", "same text", "s", 1, 2)] * 100
    rows += [(8, "b", "w " * 20_000, "s", 1, 2), (9, "b", None, "s", 1, 2), (9, "void", " \t", "s", 1, 2)]
    first = checked(spark, rows, shard_words=256)
    again = checked(spark, rows[::-1], shard_words=256)
    assert first.groupBy("shard").count().count() > 2
    assert sorted(r.taken for r in first.collect()) == sorted(r.taken for r in again.collect())
    frame = spark.createDataFrame(rows[:1], "doc_id long, source string, text string, size string, _start int, shard int")
    assert mix(frame.limit(0), count_words(F.col("text"))).collect() == []
    blank = mix(frame.withColumn("text", F.lit(" ")), count_words(F.col("text"))).collect()
    assert [(r["size"], r.source_size, r.target, r.pieces) for r in blank] == [(0, 0, 0.0, [])]


def test_primes():
    assert all(all(p % q for q in range(2, 46342)) for p in PRIMES)


def test_no_python_in_plan(spark, sf):
    plan = op12_source_mix(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
