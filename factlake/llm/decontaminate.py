"""Benchmark decontamination with an inverted index of the test items.

Index: every item is a document of its words, with BM25 impacts divided by
their sum, so an item that a passage holds whole scores 1. Postings are sorted
by item in blocks of `BLOCK_ITEMS`; each term knows its largest impact overall
and in every block. Items are cut into words, and their index is built, in
tasks: document frequencies and the mean length are counted over all items,
then each group of items of one length class and about `GROUP_WORDS` words
becomes an index of its own, so scores do not depend on the groups.

Query: every passage of every text. Passages are windows of twice the longest
item of the length class that overlap by half, so each item-long piece of a
text lies in one window. Retrieval applies the tests of block-max WAND to many
passages at once: the terms of the least impacts, which together stay below
half of the threshold, cannot make a hit alone and are left out at first; a
passage is skipped if its terms' largest impacts do not reach what is left;
then every block of items whose block maxima do not reach it; only the postings
of the remaining blocks are read, and what remains is scored in full. All items
at or above the threshold come out, without a top k.

Verification: an item is cut into question and answer (behind its first `?`
or line end, else in the middle). A passage counts if it holds at least
`OVERLAP` of the five-word runs of both. Of an item with fewer than `MIN_WORDS`
words, which has no such run, it must hold all words one after the other.

Texts are never shuffled. Indexes of `SHARED_WORDS` words together are
broadcast at a time; a larger benchmark makes several passes over the texts.
The driver holds one such part.

Null texts and texts without words give nothing; so do items without a word.
Equal items are found under each of their ids; several rows of one item id are
several items, and items without an id are reported with a null id. Rows
without a document id are reported with a null id. Only id and text are read.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.texts import fields, ragged, text_chunks
from factlake.operators.scale import lookup_join, materialize

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.5
RUN = 5
MIN_WORDS = 5
BLOCK_ITEMS = 16
SHORTEST_WINDOW = 64
GROUP_WORDS = 400_000
SHARED_WORDS = 1_600_000
TERM = re.compile(r"\w+")


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    cut = re.search(r"[?\n]", text)
    if cut:
        question, answer = terms(text[: cut.end()]), terms(text[cut.end() :])
        if question and answer:
            return question, answer
    whole = terms(text)
    return whole[: len(whole) // 2], whole[len(whole) // 2 :]


def runs(words: list, size: int) -> list[tuple]:
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


class Index:
    """Items of one length class (id, words with their counts, question,
    answer), their postings, and the search. `df` says how many of all `n`
    items have a word, `mean` how many words they have on average."""

    def __init__(
        self,
        items: Sequence[tuple[object, dict[str, int], list[str], list[str]]],
        df: dict[str, int],
        n: int,
        mean: float,
        threshold: float,
    ) -> None:
        self.ids = [i for i, *_ in items]
        lengths = [len(q) + len(a) for *_, q, a in items]
        self.half = max(map(length_class, lengths))
        self.threshold = threshold
        impacts = []
        for (_, counts, *_), length in zip(items, lengths):
            norm = K1 * (1 - B + B * length / mean)
            own = {
                t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * k * (K1 + 1) / (k + norm)
                for t, k in sorted(counts.items())
            }
            total = sum(own.values())
            impacts.append({t: x / total for t, x in own.items()})
        largest: dict[str, float] = {}
        for own in impacts:
            for t, x in own.items():
                largest[t] = max(largest.get(t, 0.0), x)
        # Terms by falling impact; the last ones are not essential
        order = sorted(largest, key=lambda t: (-largest[t], t))
        tail = np.cumsum([largest[t] for t in reversed(order)])
        spare = int(np.searchsorted(tail, threshold / 2, "right"))
        self.essential = len(order) - spare
        self.missing = float(tail[spare - 1]) if spare else 0.0
        self.at = {t: i for i, t in enumerate(order)}
        numbers = [[self.at[w] for w in part] for *_, q, a in items for part in (q, a)]
        self.part_ends = np.cumsum([len(x) for x in numbers])
        self.words = np.array([w for x in numbers for w in x], np.int32)
        self.largest = np.array([largest[t] for t in order])
        rows = sorted((self.at[t], i, x) for i, own in enumerate(impacts) for t, x in own.items())
        term, item = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        self.item, self.impact = item, np.array([r[2] for r in rows])
        self.starts = np.searchsorted(term, np.arange(len(order)))
        self.sizes = np.bincount(term, minlength=len(order))
        block = item // BLOCK_ITEMS
        new = np.ones(len(rows), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        self.block, self.block_max = block[first], np.maximum.reduceat(self.impact, first)
        self.block_starts = np.searchsorted(term[first], np.arange(len(order)))
        self.block_sizes = np.bincount(term[first], minlength=len(order))
        self.blocks = int(block.max()) + 1

    def _summed(self, keys: np.ndarray, values: np.ndarray, least: float):
        """Keys whose values add up to `least`, and the sums."""
        keys, at = np.unique(keys, return_inverse=True)
        sums = np.bincount(at, values, len(keys))
        return keys[sums >= least - 1e-9], sums[sums >= least - 1e-9]

    def search(self, found: np.ndarray, counts: np.ndarray):
        """Windows and items at or above the threshold, with their scores.
        `found`: term numbers (-1: none) of texts with `counts` words each."""
        text = np.repeat(np.arange(len(counts)), counts)
        place = ragged(np.zeros(len(counts), np.int64), counts)
        cells = -(-counts // self.half)
        windows = np.maximum(cells - 1, 1)
        base = np.cumsum(windows) - windows
        known = np.flatnonzero(found >= 0)
        text, cell, term = text[known], place[known] // self.half, found[known]
        # A word is in the window that starts with its cell and in the one before
        own = base[text] + np.minimum(cell, windows[text] - 1)
        before = base[text] + np.maximum(cell - 1, 0)
        size = len(self.largest)
        keys = np.unique(np.concatenate([own * size + term, before * size + term]))
        window, term = keys // size, keys % size
        need = self.threshold - self.missing
        e = term < self.essential
        w, t = window[e], term[e]
        total = int(windows.sum())
        alive = np.bincount(w, self.largest[t], total) >= need - 1e-9
        w, t = w[alive[w]], t[alive[w]]
        # blocks
        b = ragged(self.block_starts[t], self.block_sizes[t])
        bw = np.repeat(w, self.block_sizes[t])
        kept, _ = self._summed(bw * self.blocks + self.block[b], self.block_max[b], need)
        # postings of the blocks that are left
        p = ragged(self.starts[t], self.sizes[t])
        pw = np.repeat(w, self.sizes[t])
        inside = np.isin(pw * self.blocks + self.item[p] // BLOCK_ITEMS, kept)
        p, pw = p[inside], pw[inside]
        items = len(self.ids)
        pairs, _ = self._summed(pw * items + self.item[p], self.impact[p], need)
        # full scores of the pairs that are left, with all terms
        full = np.isin(window, pairs // items)
        w, t = window[full], term[full]
        p = ragged(self.starts[t], self.sizes[t])
        key = np.repeat(w, self.sizes[t]) * items + self.item[p]
        inside = np.isin(key, pairs)
        pairs, scores = self._summed(key[inside], self.impact[p[inside]], self.threshold)
        of = np.searchsorted(base, pairs // items, "right") - 1
        start = (pairs // items - base[of]) * self.half
        return of, start, pairs % items, scores

    def part(self, number: int) -> list[int]:
        """Term numbers of a question (2 * item) or an answer (2 * item + 1)."""
        end = self.part_ends[number]
        return self.words[self.part_ends[number - 1] if number else 0 : end].tolist()

    def overlap(self, words: list[int], item: int) -> tuple[float, float]:
        """Shares of the question's and the answer's runs that a passage has."""
        parts = [self.part(2 * item), self.part(2 * item + 1)]
        if (size := len(parts[0]) + len(parts[1])) < MIN_WORDS:
            held = float(tuple(parts[0] + parts[1]) in runs(words, size))
            return held, held
        out = []
        for part in parts:
            size = min(RUN, len(part))
            own, has = runs(part, size), set(runs(words, size))
            out.append(sum(r in has for r in own) / len(own))
        return out[0], out[1]


def length_class(words: int) -> int:
    """Items of one class share their windows: up to 64 words, 128, 256, ..."""
    return max(SHORTEST_WINDOW, 1 << (words - 1).bit_length())


def parse_items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """A row for every item with a word: no, id, kind (length class), n_words,
    words with their counts, question and answer; written down."""
    kind = dict(benchmark.dtypes)[key]
    lists = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "_text"):
            parts = [question_and_answer(t) for t in texts]
            counts = [Counter(q + a) for q, a in parts]
            sizes = [len(q) + len(a) for q, a in parts]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([length_class(n) for n in sizes], pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array([list(c) for c in counts], lists),
                pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())),
                *(pa.array(list(side), lists) for side in (zip(*parts) if parts else ([], []))),
            ]
            names = ["no", "id", "kind", "n_words", "words", "counts", "question", "answer"]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array([n > 0 for n in sizes]))

    given = benchmark.filter(F.col(text).isNotNull()).select(
        F.monotonically_increasing_id().alias("no"), F.col(key).alias("id"), F.col(text).cast("string").alias("_text")
    )
    out = f"no bigint, id {kind}, kind bigint, n_words bigint, words array<string>, counts array<bigint>"
    return materialize(given.mapInArrow(run, f"{out}, question array<string>, answer array<string>"), "items")


def build_indexes(benchmark: DataFrame, key: str, text: str, threshold: float, group_words: int) -> DataFrame:
    """n_words and the pickled index of every group of items; written down."""
    items = parse_items(benchmark, key, text)
    # One row per length class: powers of two
    kinds = items.groupBy("kind").agg(F.count("*").alias("n"), F.sum("n_words").alias("words")).collect()
    n, total = sum(r.n for r in kinds), sum(r.words for r in kinds)
    parts = F.lit(1)
    for r in kinds:
        parts = F.when(F.col("kind") == r.kind, -(-r.words // group_words)).otherwise(parts)
    grouped = items.withColumn("part", F.pmod(F.xxhash64("no"), parts))
    posted = items.select("no", F.explode(F.arrays_zip("words", "counts")).alias("_p")).select(
        "no", F.col("_p.words").alias("term"), F.col("_p.counts").alias("k")
    )
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    known = lookup_join(posted, df, "term", "no").groupBy("no").agg(F.collect_list(F.struct("term", "k", "df")).alias("posts"))

    def build(rows: pa.Table) -> pa.Table:
        parsed, df = [], {}
        for r in sorted(rows.to_pylist(), key=lambda r: r["no"]):
            df.update((p["term"], p["df"]) for p in r["posts"])
            parsed.append((r["id"], {p["term"]: p["k"] for p in r["posts"]}, r["question"], r["answer"]))
        index = Index(parsed, df, n, total / n, threshold)
        return pa.table({"n_words": [pc.sum(rows["n_words"]).as_py()], "packed": [pickle.dumps(index)]})

    if not n:
        return benchmark.sparkSession.createDataFrame([], "n_words bigint, packed binary")
    ready = grouped.join(known, "no").select("kind", "part", "no", "id", "n_words", "posts", "question", "answer")
    return materialize(ready.groupBy("kind", "part").applyInArrow(build, "n_words bigint, packed binary"), "indexes")


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
    group_words: int = GROUP_WORDS,
) -> DataFrame:
    """(`key`, `item_key`, score, question_overlap, answer_overlap) of every
    text and every item that it leaks; of several passages the best."""
    spark = df.sparkSession
    kind = dict(benchmark.dtypes)[item_key]
    id_type = benchmark.select(item_key).limit(0).toArrow().schema.types[0]
    names = [key, item_key, "score", "question_overlap", "answer_overlap"]
    out = f"{fields(df, [key])}, `{item_key}` {kind}, score double, "
    out += "question_overlap double, answer_overlap double"
    given = df.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    result: DataFrame | None = None
    for shared in _indexes(benchmark, item_key, item_text, threshold, group_words):
        part = given.mapInArrow(_reporter(shared, overlap, names, id_type), out)
        result = part if result is None else result.unionByName(part)
    return result if result is not None else spark.createDataFrame([], out)


def drop_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
    group_words: int = GROUP_WORDS,
) -> DataFrame:
    """Rows of `df`, unchanged, whose text leaks no item."""

    def filtered(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in text_chunks(batches, text):
                keep = np.ones(len(texts), bool)
                keep[[of for of, _, _ in leaks(shared.value, texts, overlap)]] = False
                yield batch.filter(pa.array(keep))

        return run

    for shared in _indexes(benchmark, item_key, item_text, threshold, group_words):
        df = df.mapInArrow(filtered(shared), df.schema)
    return df


def _indexes(benchmark: DataFrame, key: str, text: str, threshold: float, group_words: int):
    """Broadcasts of indexes; together they hold all items."""
    open_: list[Index] = []
    room = 0
    for row in build_indexes(benchmark, key, text, threshold, group_words).toLocalIterator():
        if open_ and room + row.n_words > SHARED_WORDS:
            yield benchmark.sparkSession.sparkContext.broadcast(open_)
            open_, room = [], 0
        open_.append(pickle.loads(row.packed))
        room += row.n_words
    if open_:
        yield benchmark.sparkSession.sparkContext.broadcast(open_)


def leaks(indexes: list[Index], texts: list[str], least: float) -> dict[tuple, tuple]:
    """(text, index, item) to (score, question overlap, answer overlap)."""
    words = [terms(t) for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    best: dict[tuple[int, int, int], tuple[float, float, float]] = {}
    ends = np.cumsum(counts)
    for g, index in enumerate(indexes):
        get = index.at.get
        found = np.fromiter((get(w, -1) for ws in words for w in ws), np.int64, counts.sum())
        for of, start, item, score in zip(*(x.tolist() for x in index.search(found, counts))):
            first = int(ends[of] - counts[of]) + start
            passage = found[first : min(first + 2 * index.half, int(ends[of]))].tolist()
            question, answer = index.overlap(passage, item)
            if question >= least and answer >= least:
                row = (round(min(score, 1.0), 6), question, answer)
                best[of, g, item] = max(row, best.get((of, g, item), row))
    return best


def _reporter(shared, least: float, names: list[str], id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "_text"):
            rows = sorted(leaks(shared.value, texts, least).items())
            if not rows:
                continue
            who = pa.array([of for (of, _, _), _ in rows], pa.int64())
            ids = [shared.value[g].ids[item] for (_, g, item), _ in rows]
            columns = [batch.column(0).take(who), pa.array(ids, id_type)]
            columns += [pa.array([v[k] for _, v in rows], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run
