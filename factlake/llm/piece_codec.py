"""Encoding and decoding with a piece vocabulary by batched Viterbi passes.

Units (runs of pieces that no piece can cross) of equal length advance
together, one character at a time. For every end the substrings of all
possible lengths are looked up by rolling hash (a sieve of their first bits,
then the sorted hashes of the pieces); of the admissible candidates a vectorised maximum keeps one, whose
start is the backpointer; the ids are read off from the end.

The given vocabulary is one of ranked merges, whose result is not the path of
the highest score sum. So a candidate is admissible only if it may follow the
last piece of the best path up to its start: if ranked merging of the two
pieces joined gives the same two pieces. For such a vocabulary exactly one
candidate is admissible at every end, and the path equals ranked merging
(compared with the library in the tests). Characters without a piece become
their bytes' pieces.

Null text counts as empty (no ids). Only key and text are read. Long texts are
handled whole, in chunks of units; a unit above `LONG` characters runs alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.texts import REMEMBERED, UnitTable, fields, ragged, sum_by, text_chunks

SPACE = "▁"
LONG = 200
# Characters of units that advance together
CELLS = 400_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
FAR = np.int64(1) << 40
# Shifts that leave the 20 bits by which the sieve and the answers are found
SIEVE = ASKED = np.uint64(44)


class PieceCodec:
    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in ids]
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        if model.normalize("a  ﬁ ") != f"{SPACE}a{SPACE}{SPACE}ﬁ{SPACE}":
            raise ValueError(f"{path}: normalises text; only identity with a leading space is known")
        self.byte_ids = np.full(256, -1, np.int32)
        for i in ids:
            if model.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError(f"{path}: has no pieces for all bytes")
        usable = [i for i in ids if i not in special and not model.is_byte(i)]
        if any(SPACE in names[i].lstrip(SPACE) for i in usable):
            raise ValueError(f"{path}: has pieces across spaces")
        # Symbols in merge order: single characters first, then by score. One
        # more stands for all characters without a piece.
        usable.sort(key=lambda i: (len(names[i]) > 1, -model.get_score(i), i))
        self.names = [names[i] for i in usable]
        self.ids = np.array([*usable, -1], np.int32)
        self.unknown = len(usable)
        self.at = {n: s for s, n in enumerate(self.names)}
        self._build_merges()
        self.longest = max(map(len, self.names))
        made = [s for s in range(len(self.names)) if self.reachable[s]]
        hashes = np.array([self._hash(self.names[s]) for s in made], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.symbols = hashes[order], np.array(made, np.int64)[order]
        if (np.diff(self.hashes) == 0).any():
            raise ValueError(f"{path}: two pieces have one hash")
        # Which values the mixed hashes of pieces begin with: most substrings
        # are no pieces, and are told so without a search.
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hashes * FACTOR) >> SIEVE] = True
        self.asked = np.full(1 << 20, -1, np.int64)
        self.alphabet = np.array(sorted(ord(n) for n in self.names if len(n) == 1), np.uint32)
        newline = "" if "\n" in self.at else "\n"
        self.units = re.compile(rf"{SPACE}*[^{SPACE}{newline}]+|{SPACE}+" + "|\n" * bool(newline))
        self.table = UnitTable(self._encode, remembered)
        # for decoding: the bytes of every id
        raw = [b""] * len(names)
        for i in usable:
            raw[i] = names[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            raw[i] = bytes([b])
        self.raw_sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    # ---- merges ----

    def _build_merges(self) -> None:
        """All pairs of pieces that make a piece, and of each piece the pair
        merged last when it is made from its characters."""
        size = len(self.names) + 1
        pairs: dict[tuple[int, int], int] = {}
        for s, name in enumerate(self.names):
            for cut in range(1, len(name)):
                a, b = self.at.get(name[:cut]), self.at.get(name[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = s
        self.pairs = pairs
        self.first = np.arange(size)
        self.second = np.arange(size)
        self.reachable = np.ones(size, bool)
        for s, name in enumerate(self.names):
            if len(name) > 1:
                parts, last = self.merge([self.at.get(c, size - 1) for c in name])
                self.reachable[s] = parts == [s]
                if parts == [s]:
                    self.first[s], self.second[s] = last
        keys = np.array([a * size + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_made = np.fromiter(pairs.values(), np.int64, len(pairs))[order]

    def merge(self, symbols: list[int]) -> tuple[list[int], tuple[int, int] | None]:
        """Plain ranked merging of a short list; also the last merged pair."""
        last = None
        while len(symbols) > 1:
            made = [self.pairs.get(p, FAR) for p in zip(symbols, symbols[1:])]
            best = min(made)
            if best == FAR:
                break
            i = made.index(best)
            last = (symbols[i], symbols[i + 1])
            symbols = [*symbols[:i], int(best), *symbols[i + 2 :]]
        return symbols, last

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """May the symbols `right` stand behind `left`? Both are taken apart
        again, the younger merge first; an earlier merge across the border
        would have come before."""
        size = len(self.names) + 1
        out = np.zeros(len(left), bool)
        who = np.arange(len(left))
        a, b = left.astype(np.int64), right.astype(np.int64)
        limit = np.full(len(a), FAR)
        while len(who):
            wanted = a * size + b
            at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[at] == wanted) & (self.pair_made[at] < limit)
            whole_a, whole_b = self.second[a] == a, self.first[b] == b
            done = ~crossed & whole_a & whole_b
            out[who[done]] = True
            go = ~crossed & ~done
            who, a, b, limit, whole_a, whole_b = (
                x[go] for x in (who, a, b, limit, whole_a, whole_b)
            )
            take_a = ~whole_a & (whole_b | (a > b))
            limit = np.where(take_a, a, b + 1)
            a, b = np.where(take_a, self.second[a], a), np.where(take_a, b, self.first[b])
        return out

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`follows`, with the last answers remembered: few pairs are common."""
        pair = left * (len(self.names) + 1) + right
        at = (pair.astype(np.uint64) * FACTOR) >> ASKED
        said = self.asked[at]
        out, new = (said & 1).astype(bool), np.flatnonzero(said >> 1 != pair)
        if len(new):
            out[new] = self.follows(left[new], right[new])
            self.asked[at[new]] = pair[new] << 1 | out[new]
        return out

    # ---- encoding ----

    @staticmethod
    def _hash(name: str) -> np.uint64:
        value = 0
        for c in name:
            value = (value * int(FACTOR) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return np.uint64(value)

    def _viterbi(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words of one length, flat, and how many each word has."""
        count, length = chars.shape
        at = np.minimum(np.searchsorted(self.alphabet, chars), len(self.alphabet) - 1)
        known = self.alphabet[at] == chars
        prefix = np.zeros((length + 1, count), np.uint64)
        for i in range(length):
            prefix[i + 1] = prefix[i] * FACTOR + chars[:, i].astype(np.uint64) + np.uint64(1)
        powers = FACTOR ** np.arange(min(length, self.longest) + 1, dtype=np.uint64)
        # All pieces at all places, by their ends, shorter ones first
        cells, symbols, sizes = [], [], []
        for n in range(1, len(powers)):
            hashed = (prefix[n:] - prefix[:-n] * powers[n]).ravel()
            cell = np.flatnonzero(self.sieve[(hashed * FACTOR) >> SIEVE])
            hashed = hashed[cell]
            at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
            hit = self.hashes[at] == hashed
            cells.append(cell[hit] + n * count)
            symbols.append(self.symbols[at[hit]])
            sizes.append(np.full(len(cells[-1]), n))
        ends, words = np.divmod(np.concatenate(cells), count)
        order = np.argsort(ends.astype(np.uint16), kind="stable")
        borders = np.searchsorted(ends[order], np.arange(length + 2))
        words, symbols, sizes = (x[order] for x in (words, np.concatenate(symbols), np.concatenate(sizes)))
        best = np.full((length + 1, count), -1, np.int64)
        size = np.zeros((length + 1, count), np.int64)
        best[1:], size[1:] = np.where(known.T, -1, self.unknown), ~known.T
        for end in range(1, length + 1):
            part = slice(borders[end], borders[end + 1])
            who, symbol, n = words[part], symbols[part], sizes[part]
            before = best[end - n, who]
            ok = n == end
            ask = np.flatnonzero(before >= 0)
            ok[ask] = self.may_follow(before[ask], symbol[ask])
            # of several admissible candidates the last, longest one stays
            who = who[ok]
            best[end, who], size[end, who] = symbol[ok], n[ok]
        return self._trace(best, size)

    @staticmethod
    def _trace(best: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length, count = best.shape[0] - 1, best.shape[1]
        end = np.full(count, length)
        who = np.arange(count)
        found = np.full((count, length), -1, np.int64)
        while len(who):
            found[who, end - 1] = best[end, who]
            end = end - size[end, who]
            who, end = who[end > 0], end[end > 0]
        return found[found >= 0], (found >= 0).sum(1)

    def _long(self, text: str) -> list[int]:
        """The same passes for one long unit, with plain dictionaries."""
        may: dict[tuple[int, int], bool] = {}

        def follows(a: int, b: int) -> bool:
            if (a, b) not in may:
                may[a, b] = bool(self.follows(np.array([a]), np.array([b]))[0])
            return may[a, b]

        best, size = [-1], [0]
        for end in range(1, len(text) + 1):
            chosen = (self.unknown, 1)
            for n in range(1, min(end, self.longest) + 1):
                s = self.at.get(text[end - n : end])
                if s is not None and self.reachable[s] and (n == end or follows(best[end - n], s)):
                    chosen = (s, n)
            best.append(chosen[0])
            size.append(chosen[1])
        out, end = [], len(text)
        while end:
            out.append(best[end])
            end -= size[end]
        return out[::-1]

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(lengths, kind="stable")
        counts = np.zeros(len(units), np.int64)
        parts: list[np.ndarray] = []
        first = 0
        while first < len(order):
            n = int(lengths[order[first]])
            last = int(np.searchsorted(lengths[order], n, "right"))
            last = min(last, first + max(1, CELLS // n))
            who = order[first:last]
            if n > LONG:
                who = who[:1]
                symbols = np.array(self._long(units[who[0]]), np.int64)
                counts[who] = len(symbols)
            else:
                text = "".join(units[i] for i in who)
                chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(who), n)
                symbols, counts[who] = self._viterbi(chars)
            parts.append(symbols)
            first += len(who)
        flat = self.ids[np.concatenate(parts)]
        starts = np.zeros(len(units), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        ids = flat[ragged(starts, counts)]
        return self._bytes(units, ids, counts) if (ids < 0).any() else (ids, counts)

    def _bytes(self, units, ids, counts) -> tuple[np.ndarray, np.ndarray]:
        """Put the bytes' pieces where a character has no piece."""
        out, ends = [], np.cumsum(counts)
        counts = counts.copy()
        for i, unit in enumerate(units):
            own = ids[ends[i] - counts[i] : ends[i]]
            if (own < 0).any():
                strange = iter([c for c in unit if c not in self.at])
                own = np.concatenate(
                    [self.byte_ids[list(next(strange).encode())] if s < 0 else [s] for s in own]
                )
            out.append(own)
        return np.concatenate(out).astype(np.int32), np.fromiter(map(len, out), np.int64, len(out))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        parts = [
            self.units.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts
        ]
        at, counts = self.table.find(parts)
        return self.table.ids(at), sum_by(counts, self.table.sizes(at))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts again; a byte sequence that is no text is marked."""
        sizes = self.raw_sizes[ids]
        raw = self.raw[ragged(self.raw_starts[ids], sizes)].tobytes()
        lengths = sum_by(counts, sizes)
        ends = np.cumsum(lengths).tolist()
        out = [raw[e - n : e].decode("utf-8", "replace") for e, n in zip(ends, lengths.tolist())]
        return [t[1:] if t.startswith(" ") else t for t in out]


@lru_cache(2)
def codec(path: str, remembered: int = REMEMBERED) -> PieceCodec:
    return PieceCodec(path, remembered)


PIECES = ["n_pieces", "piece_ids", "round_trip"]


def add_pieces(
    df: DataFrame, path: str, text: str = "text", remembered: int = REMEMBERED
) -> DataFrame:
    """All columns of `df` with n_pieces, piece_ids and round_trip (is the
    decoded text the text?); columns of these names are replaced. A worker
    remembers the pieces of up to `remembered` units."""
    kept = df.select(*[c for c in df.columns if c not in PIECES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, text):
            own = codec(path, remembered)
            ids, counts = own.encode(texts)
            same = [a == b for a, b in zip(own.decode(ids, counts), texts)]
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            columns = [*batch.columns, pa.array(counts), lists, pa.array(same)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *PIECES])

    out = f"{fields(kept, kept.columns)}, n_pieces bigint, piece_ids array<int>, round_trip boolean"
    return kept.mapInArrow(run, out)


def encode_pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_pieces, piece_ids and round_trip of every row."""
    return add_pieces(df.select(key, text), path, text).drop(text)


def decode_pieces(df: DataFrame, path: str, key: str = "doc_id", ids: str = "piece_ids") -> DataFrame:
    """`key` and the text of every row's ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            counts = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            texts = codec(path).decode(lists.flatten().to_numpy(), counts.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts)], names=[key, "text"])

    import pyarrow.compute  # noqa: F401

    given = F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("_ids")
    return df.select(key, given).mapInArrow(run, f"{fields(df, [key])}, text string")
