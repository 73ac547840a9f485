"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (1 to 3
characters of lower-cased words, with a mark before and behind a word), most
frequent first. A document's profile is compared to each language's by
out-of-place distance: for every n-gram of the document the difference of its
two ranks, or the profile size if the language's profile lacks it. The nearest
language wins; ties go to the first name.

Profiles are learned from all labelled rows, without a sample: every task adds
up its own counts, and only sums per n-gram are shuffled. An n-gram is the
number made of its (up to three) code points, which also breaks ties of
frequency. The profiles, labels x `PROFILE` rows, go to every task; more than
`MAX_LABELS` labels are refused.

Null text, and text without a letter, is `und` with score 0; so is every text
if nothing is labelled. Rows with a null label are not learned from. Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.texts import fields, text_chunks
from factlake.operators.scale import top_n_per_group

PROFILE = 500
MAX_LABELS = 2_000
HELD_GRAMS = 1_000_000
LEARN_BYTES = 500_000
UNKNOWN = "und"
EDGE = 1
# Below this score a text has next to nothing in common with any language.
MIN_SCORE = 0.2


@lru_cache(1)
def letters() -> np.ndarray:
    """Is the code point a letter?"""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """The n-grams of a text as numbers, repeats included: their code points,
    21 bits each. EDGE stands before and behind each word."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    line = np.full(len(points) + 2, EDGE, np.int64)
    line[1:-1] = np.where(letters()[points], points, EDGE)
    inner = line != EDGE
    keep = inner.copy()
    keep[0] = True
    keep[1:] |= inner[:-1]
    s, inner = line[keep], inner[keep]
    if not inner.any():
        return np.zeros(0, np.int64)
    three = (s[:-2] << 42 | s[1:-1] << 21 | s[2:])[inner[1:-1]]
    return np.concatenate([s[inner], s[:-1] << 21 | s[1:], three])


def profile(text: str, size: int = PROFILE) -> np.ndarray:
    codes, counts = np.unique(grams(text), return_counts=True)
    return codes[np.lexsort((codes, -counts))[:size]]


def learn_profiles(
    df: DataFrame, label: str = "lang", text: str = "text", size: int = PROFILE
) -> DataFrame:
    """Rows (label, gram, rank from 1) of every label's profile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            names, codes, sums = [], [], []
            for name, parts in held.items():
                code, n = _added(parts)
                names += [name] * len(code)
                codes.append(code)
                sums.append(n)
            columns = [pa.array(names, pa.string()), *(pa.array(np.concatenate(x)) for x in (codes, sums))]
            return pa.RecordBatch.from_arrays(columns, names=["label", "gram", "n"])

        for batch, texts in text_chunks(batches, "_text", LEARN_BYTES):
            by_label: dict[str, list[str]] = {}
            for name, t in zip(batch.column(0).to_pylist(), texts):
                by_label.setdefault(name, []).append(t)
            for name, own in by_label.items():
                found = np.unique(np.concatenate([grams(t) for t in own]), return_counts=True)
                parts = held.setdefault(name, [])
                parts.append(found)
                if len(parts) > 8:
                    parts[:] = [_added(parts)]
            size = sum(len(p[0]) for parts in held.values() for p in parts)
            if size > HELD_GRAMS:
                yield rows()
                held.clear()
        if held:
            yield rows()

    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")
    labelled = df.filter(F.col(label).isNotNull())
    named = labelled.select(F.col(label).cast("string").alias("label"), whole)
    counts = named.mapInArrow(run, "label string, gram bigint, n bigint")
    counts = counts.groupBy("label", "gram").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), F.col("gram")]
    ranked = top_n_per_group(counts, ["label"], order, size, spread_by="gram")
    return ranked.select("label", "gram", "rank")


def _added(parts):
    codes = np.concatenate([c for c, _ in parts])
    codes, at = np.unique(codes, return_inverse=True)
    sums = np.bincount(at, np.concatenate([n for _, n in parts]), len(codes))
    return codes, sums.astype(np.int64)


class Nearest:
    """Compares texts to collected profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int) -> None:
        self.names = sorted(profiles)
        self.size = size
        self.grams = np.unique(np.concatenate([profiles[n] for n in self.names]))
        # One more column: n-grams that no profile has
        self.ranks = np.full((len(self.names), len(self.grams) + 1), 1 << 30, np.int64)
        for row, name in zip(self.ranks, self.names):
            row[np.searchsorted(self.grams, profiles[name])] = np.arange(len(profiles[name]))

    def predict(self, text: str) -> tuple[str, float]:
        own = profile(text, self.size)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at[self.grams[at] != own] = len(self.grams)
        apart = np.abs(self.ranks[:, at] - np.arange(len(own)))
        distance = np.minimum(apart, self.size).sum(1)
        best = int(distance.argmin())
        return self.names[best], 1.0 - float(distance[best]) / (len(own) * self.size)


def _shared(profiles: DataFrame):
    """The profiles as a broadcast: label to n-grams in rank order."""
    if profiles.select("label").distinct().limit(MAX_LABELS + 1).count() > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} languages")
    found = profiles.toPandas().sort_values(["label", "rank"])
    by_label = {name: rows["gram"].to_numpy(np.int64) for name, rows in found.groupby("label")}
    return profiles.sparkSession.sparkContext.broadcast(by_label)


def _predictions(shared, size: int, texts: list[str]) -> list[tuple[str, float]]:
    if not shared.value:
        return [(UNKNOWN, 0.0)] * len(texts)
    nearest = Nearest(shared.value, size)
    return [nearest.predict(t) for t in texts]


def identify(
    df: DataFrame, profiles: DataFrame, key: str = "doc_id", text: str = "text", size: int = PROFILE
) -> DataFrame:
    """`key`, lang_pred and score (1: the very profile, 0: nothing in common)
    of every row."""
    shared = _shared(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "_text"):
            said = _predictions(shared, size, texts)
            names, scores = [n for n, _ in said], [s for _, s in said]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[key, "lang_pred", "score"],
            )

    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")
    out = f"{fields(df, [key])}, lang_pred string, score double"
    return df.select(key, whole).mapInArrow(run, out)


def keep_identified(
    df: DataFrame,
    profiles: DataFrame,
    text: str = "text",
    size: int = PROFILE,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """Rows of `df`, unchanged, whose text is in a known language: not `und`,
    and with a score of at least `min_score`."""
    shared = _shared(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, text):
            said = _predictions(shared, size, texts)
            yield batch.filter(pa.array([n != UNKNOWN and s >= min_score for n, s in said]))

    return df.mapInArrow(run, df.schema)


def learned_from(key: str = "doc_id"):
    """Rows that profiles are learned from: crc32 of the key's text mod 3 is
    not 1. A null key is neither learned from nor held out."""
    return F.crc32(F.col(key).cast("string")) % 3 != 1


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
