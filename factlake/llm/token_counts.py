"""Token counts by rank-synchronous merging.

A batch's pre-tokens are one flat array of symbols. In each round every
sequence finds the lowest rank among its adjacent pairs, and all sequences
merge that pair wherever it stands, at once. Sequences without a known pair
leave the array; the symbols that are left are the tokens.

Merging all places of a pair in one round equals merging them from the left
one by one, provided that no pair with a merged symbol ranks before the merge
that makes it. That is checked when the vocabulary is read; for a vocabulary
without that property each round merges only the leftmost place.

Null text counts as empty (0 tokens); rows are counted one by one, so repeated
rows repeat; other columns are not read. A text is held in memory as a whole,
a chunk of texts up to `CHUNK_BYTES` bytes.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.texts import UnitTable, fields, ragged, sum_by, text_chunks

NONE = np.iinfo(np.int64).max
# Fixed value: white space as the tokenizer's pattern engine sees it (the
# Python engines also count U+001C to U+001F).
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the pattern that byte-level vocabularies split text by.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def byte_names() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies:
    printable Latin-1 for itself, the others numbered from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [rest.get(b, chr(b)) for b in range(256)]


class MergeTable:
    """Ranked pair merges over integer symbols."""

    def __init__(self, base: np.ndarray, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        self.base = base.astype(np.int64)
        self.size = int(max(base.max(), made.max(initial=0), left.max(initial=0))) + 1
        keys = left.astype(np.int64) * self.size + right
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.ranks, self.made = keys, first.astype(np.int64), made.astype(np.int64)
        used = np.full(self.size, NONE)
        ranks = np.arange(len(left), dtype=np.int64)
        np.minimum.at(used, left, ranks)
        np.minimum.at(used, right, ranks)
        self.all_at_once = bool((used[made] > ranks).all())

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE)
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word after all merges."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = sizes.copy()
        symbols = self.base[np.frombuffer(b"".join(words), np.uint8)]
        active = np.flatnonzero(sizes > 1)
        ends = np.cumsum(sizes)
        symbols = symbols[ragged((ends - sizes)[active], sizes[active])]
        sizes = sizes[active]
        last = np.cumsum(sizes) - 1
        rank = np.full(len(symbols), NONE)
        if len(symbols):
            rank[:-1] = self.rank(symbols[:-1], symbols[1:])
            rank[last] = NONE
        while len(active):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(rank, starts)
            going = best < NONE
            if not going.all():
                out[active[~going]] = sizes[~going]
                stay = np.repeat(going, sizes)
                symbols, rank = symbols[stay], rank[stay]
                active, sizes, best = active[going], sizes[going], best[going]
                if not len(active):
                    break
                starts = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(active)), sizes)
            at = np.flatnonzero(rank == best[owner])
            if self.all_at_once:
                # x x x x: every second place of a run of overlapping pairs
                new_run = np.diff(at, prepend=-2) != 1
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(new_run, place, 0))) % 2 == 0]
            else:
                at = at[np.diff(owner[at], prepend=-1) != 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]  # NONE where the pair ended its sequence
            sizes = sizes - np.bincount(owner[at], minlength=len(active))
            moved = (np.cumsum(keep) - 1)[at]
            symbols, rank, owner = symbols[keep], rank[keep], owner[keep]
            before = moved[(moved > 0)]
            before = before[owner[before] == owner[before - 1]] - 1
            again = np.concatenate([moved, before])
            again = again[again + 1 < len(symbols)]
            again = again[owner[again] == owner[again + 1]]
            rank[again] = self.rank(symbols[again], symbols[again + 1])
        return out


class BytePairCounter:
    """Counts the tokens of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(
            model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix",
                                   "byte_fallback", "ignore_merges")
        )
        byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True)
        if not plain or not byte_level or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        added = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: special tokens that take white space")
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        column = lambda names: np.array([ids[n] for n in names], np.int64)
        self.table = MergeTable(
            column(byte_names()),
            column(a for a, _ in pairs),
            column(b for _, b in pairs),
            column(a + b for a, b in pairs),
        )
        self.split = regex.compile(SPLIT)
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.units = UnitTable(self._encode)

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(0, np.int32), self.table.counts([u.encode() for u in units])

    def count(self, texts: list[str]) -> np.ndarray:
        parts, special = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if self.special is None or not self.special.search(text):
                parts.append(self.split.findall(text))
                continue
            pieces = self.special.split(text)
            special[i] = len(pieces) - 1
            parts.append([u for piece in pieces for u in self.split.findall(piece)])
        at, counts = self.units.find(parts)
        return special + sum_by(counts, self.units.sizes(at))


@lru_cache(2)
def counter(path: str) -> BytePairCounter:
    return BytePairCounter(path)


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_bytes (UTF-8), n_tokens of every row's text."""
    out = f"{fields(df, [key])}, n_bytes bigint, n_tokens bigint"

    def run(batches):
        import pyarrow as pa

        for batch, texts in text_chunks(batches, "_text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counter(path).count(texts))],
                names=[key, "n_bytes", "n_tokens"],
            )

    whole: Column = F.coalesce(F.col(text).cast("string"), F.lit(""))
    sized = F.octet_length(whole).cast("bigint").alias("n_bytes")
    return df.select(key, sized, whole.alias("_text")).mapInArrow(run, out)
