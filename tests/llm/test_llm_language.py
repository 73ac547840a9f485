"""Rank-order profiles."""

from collections import Counter

import numpy as np
import pytest

from factlake.llm import language_id
from factlake.llm.language_id import Nearest, grams, identify, keep_identified, learn_profiles, learned_from, profile
from factlake.llm.queries import QUERIES


def slow_grams(text):
    out = Counter()
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = "_" + "_".join(words) + "_" if words else ""
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            part = line[i : i + n]
            if part != "_" and not (n == 3 and part[1] == "_"):
                out[part] += 1
    return out


def code(part):
    value = 0
    for c in part:
        value = value << 21 | (1 if c == "_" else ord(c))
    return value


@pytest.mark.parametrize("text", ["", "12 !", "A", "Ça va, été?", "ab ab", "x" * 50, "中文 😀 a", "İ ß"])
def test_grams(text):
    expected = Counter({code(p): n for p, n in slow_grams(text).items()})
    assert Counter(grams(text).tolist()) == expected


def test_profile_is_ordered_by_frequency_then_gram():
    counts = Counter(grams("ab ab ba c").tolist())
    order = sorted(counts, key=lambda g: (-counts[g], g))
    assert profile("ab ab ba c").tolist() == order
    assert profile("ab ab ba c", 3).tolist() == order[:3]


def test_distance():
    nearest = Nearest({"b": profile("zz zz"), "a": profile("ab ab")}, 500)
    assert nearest.predict("ab ab") == ("a", 1.0)
    assert nearest.predict("99") == ("und", 0.0)
    own, other = profile("abz").tolist(), profile("ab ab").tolist()
    apart = [min(abs(i - other.index(g)), 500) if g in other else 500 for i, g in enumerate(own)]
    assert nearest.predict("abz") == ("a", 1 - sum(apart) / (500 * len(own)))
    # ties go to the first name
    assert Nearest({"b": profile("xy"), "a": profile("xy")}, 500).predict("xy")[0] == "a"


def rows(spark):
    given = [
        (1, "the cat and the dog", "en", "x"), (2, "le chat et la souris", "fr", "y"), (3, None, "en", "z"),
        (4, "", "fr", "z"), (5, "the end of the day", None, "z"), (None, "la fin et le chat", "fr", "z"),
        (6, "12 34", "en", "z"), (7, "the " * 50_000, None, "z"), (1, "the cat and the dog", "en", "x"),
    ]
    return spark.createDataFrame(given, "doc_id long, text string, lang string, lang_pred string")


@pytest.mark.parametrize("held", [1_000_000, 5])
def test_profiles_count_all_rows(spark, monkeypatch, held):
    monkeypatch.setattr(language_id, "HELD_GRAMS", held)
    found = learn_profiles(rows(spark).repartition(3), size=20).collect()
    texts = {"en": ["the cat and the dog", "the cat and the dog", "12 34"], "fr": ["le chat et la souris", "la fin et le chat"]}
    for lang, own in texts.items():
        counts = sum((Counter(grams(t).tolist()) for t in own), Counter())
        expected = sorted(counts, key=lambda g: (-counts[g], g))[:20]
        got = sorted((r.rank, r.gram) for r in found if r.label == lang)
        assert got == [(i + 1, g) for i, g in enumerate(expected)]


def test_edge_rows(spark):
    profiles = learn_profiles(rows(spark))
    got = Counter((r.doc_id, r.lang_pred) for r in identify(rows(spark), profiles).collect())
    assert got == Counter({
        (1, "en"): 2, (2, "fr"): 1, (3, "und"): 1, (4, "und"): 1, (5, "en"): 1, (None, "fr"): 1, (6, "und"): 1, (7, "en"): 1,
    })
    assert all(0 <= r.score <= 1 for r in identify(rows(spark), profiles).collect())
    kept = keep_identified(rows(spark), profiles)
    assert kept.columns == rows(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "5", "7", "None"]


def test_foreign_text_goes(spark):
    profiles = learn_profiles(rows(spark))
    strange = spark.createDataFrame([(1, "привет мир"), (2, "the dog")], "doc_id long, text string")
    assert [r.doc_id for r in keep_identified(strange, profiles).collect()] == [2]


def test_nothing_learned_or_nothing_given(spark):
    nothing = learn_profiles(rows(spark).limit(0))
    assert {r.lang_pred for r in identify(rows(spark), nothing).collect()} == {"und"}
    assert identify(rows(spark).limit(0), learn_profiles(rows(spark))).collect() == []


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LABELS", 1)
    with pytest.raises(ValueError):
        identify(rows(spark), learn_profiles(rows(spark)))


def test_held_out_documents_are_recognised(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op2_language_id"](spark, sf).collect()
    assert len(got) == len(truth)
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and truth[r.doc_id] is not None]
    assert len(held) > 30 and np.mean(held) > 0.97
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    assert frame.filter(learned_from()).count() == sum(not r.held_out for r in got)
