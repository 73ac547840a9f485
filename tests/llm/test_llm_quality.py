"""Text statistics beside Python, and learned decision lists."""

import random
import re
from math import log2
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factlake.llm.quality_rules import (
    MAX_CONDITIONS, MAX_RULES, MIN_PRECISION, MIN_ROWS, RATIOS, Condition, Rule, judge, labelled_rows, learn_rules,
    measure, quantile_cuts, verdict,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(2)
    out = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "a a a a a", "\x0ba\x0cb\r\nc", "a\xa0b\x85c"]
    out += ["x y z\nx y z \nx y z\n\n \nx y z", "😀 é 中 | <> #", "a b " * 3000, "w" * 10_000]
    out += [" ".join(rng.choice("abcd") for _ in range(n)) for n in range(3, 60)]
    out += [" ".join(f"{rng.choice('abcdefghij')}{rng.randint(0, 9)}" for _ in range(400)) for _ in range(5)]
    return out


def test_statistics_equal_python(spark):
    rows = [(i, t, 1, True) for i, t in enumerate(texts())] + [(None, "a b c", 1, False)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept boolean")
    got = {r.doc_id: r for r in measure(frame).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert measure(frame.limit(0)).collect() == []


def test_long_texts_have_no_false_repeats(spark):
    """A million different words, and as many with one run twice."""
    words = F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda x: F.concat(F.lit("w"), x))
    frame = spark.range(2).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    again = F.concat("text", F.lit(" w77 w78 w79 w80"))
    frame = frame.withColumn("text", F.when(F.col("doc_id") == 1, again).otherwise(F.col("text")))
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in measure(frame).collect()}
    assert got == {0: (1_000_000, 0), 1: (1_000_004, 8)}


def test_plan_has_no_python(spark, sf):
    out = measure(spark.read.parquet(f"{sf}/documents.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = labelled_rows(out, labels)
    rules = [Rule((Condition("symbol_share", True, 0, 0.5),))]
    for frame in (out, rows, rows.groupBy("_prune").agg(F.sum("symbol_share")), judge(out, rules)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def labelled(spark):
    """Bad: many symbols, or shouted."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        words = [f"w{rng.randint(0, 5000)}x" for _ in range(80)]
        kind = i % 9
        if kind == 0:
            words = [w + "#" for w in words]
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), int(kind > 1)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return frame.select("doc_id", "text"), frame.select("doc_id", "quality")


def test_rules_find_what_is_bad(spark):
    documents, labels = labelled(spark)
    extra = spark.createDataFrame([(1, None), (None, 0), (5000, 0), (4, 1)], "doc_id long, quality int")
    measured = measure(documents)
    rules = learn_rules(measured, labels.unionByName(extra))
    assert 1 <= len(rules) <= 4
    judged = judge(measured, rules).join(labels, "doc_id")
    assert judged.filter(F.col("kept") != (F.col("quality") == 1)).isEmpty()
    assert all(" >= " in str(r) or " < " in str(r) for r in rules)


def slow_rules(rows, cuts):
    """Sequential covering on rows instead of sums: every cut of every ratio is
    tried on every row that is left."""

    def holds(row, conditions):
        return all((row[n] > cut) == up for n, up, cut in conditions)

    left = [{n: sum(t <= r[n] for t in cuts[n]) for n in RATIOS} | {"bad": r["_bad"], "prune": r["_prune"]} for r in rows]
    out = []
    while len(out) < MAX_RULES:
        grown = []
        while len(grown) < MAX_CONDITIONS:
            inside = [r for r in left if not r["prune"] and holds(r, grown)]
            p0 = sum(r["bad"] for r in inside)
            n0 = len(inside) - p0
            best, gain = None, 1e-9
            for name in RATIOS if p0 and n0 else ():
                filled = sorted({r[name] for r in inside})
                for cut in [b - 1 for b in filled[1:]]:
                    for up in (False, True):
                        own = [r for r in inside if (r[name] > cut) == up]
                        a = sum(r["bad"] for r in own)
                        g = a * (log2(a / len(own)) - log2(p0 / (p0 + n0))) if a else 0
                        if g > gain:
                            best, gain = (name, up, cut), g
            if best is None:
                break
            grown.append(best)
        scores = []
        for size in range(1, len(grown) + 1):
            own = [r["bad"] for r in left if r["prune"] and holds(r, grown[:size])]
            p, n = sum(own), len(own) - sum(own)
            scores.append(((p - n) / (p + n) if own else -1.0, -size, p, n))
        if not scores:
            break
        _, size, p, n = max(scores)
        if p < MIN_ROWS or p < MIN_PRECISION * (p + n):
            break
        rule = grown[: -size]
        out.append(" and ".join(f"{n} {'>=' if up else '<'} {cuts[n][cut]:g}" for n, up, cut in rule))
        left = [r for r in left if not holds(r, rule)]
    return out


@pytest.mark.parametrize("noise", [0.0, 0.03])
def test_rules_equal_brute_force(spark, noise):
    documents, labels = labelled(spark)
    wrong = F.pmod(F.xxhash64("doc_id"), F.lit(100)) < 100 * noise
    labels = labels.withColumn("quality", F.when(wrong, 1 - F.col("quality")).otherwise(F.col("quality")))
    measured = measure(documents)
    rows = labelled_rows(measured, labels)
    expected = slow_rules([r.asDict() for r in rows.collect()], quantile_cuts(rows))
    assert expected and [str(r) for r in learn_rules(measured, labels)] == expected


@pytest.mark.parametrize("value", [0, 1, None])
def test_one_class_has_no_rules(spark, value):
    documents, labels = labelled(spark)
    same = labels.withColumn("quality", F.lit(value).cast("int"))
    measured = measure(documents)
    assert learn_rules(measured, same) == []
    assert learn_rules(measured, labels.limit(0)) == []
    assert judge(measured, []).filter("kept").count() == 900


def test_first_rule_that_holds_decides(spark):
    measured = measure(spark.createDataFrame([(1, "a# " * 10), (2, "b " * 10)], "doc_id long, text string"))
    rules = [Rule((Condition("symbol_share", True, 0, 0.5),)), Rule((Condition("word_length", False, 0, 0.5),))]
    got = {r.doc_id: r.v for r in measured.select("doc_id", verdict(rules).alias("v")).collect()}
    assert got == {1: False, 2: True}


def test_documents_are_judged_like_their_labels(spark, sf):
    from factlake.llm.queries import QUERIES

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = QUERIES["op3_quality_rules"](spark, sf).join(labels, "doc_id").filter("not base_failed")
    right = out.filter(F.col("kept") == (F.col("quality") == 1)).count()
    assert right >= 0.9 * out.count()
