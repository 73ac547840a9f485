"""Token ids in directly addressable codes.

A segment holds the ids of consecutive documents. Level 0 has the lowest byte
of every id, level k the k-th byte of those ids that are long enough. Beside a
level stands its continuation bitmap (has the id a byte on the next level?),
and beside that a directory with the number of set bits before every 512. So
token i is found by one rank per level, without decoding its neighbours, and
the tokens lo..hi are one contiguous piece of every level.

Segments are rows of Parquet files: any file system that Spark writes to can
hold them, a task that is lost is written anew, and readers skip the codes
when they need only the counts. Segments are in ascending document order:
`shard` counts the sorted ranges, `segment` the rows in a range,
`shard_start` the tokens of the range before the segment.

Null text counts as empty: only the end id is written. A null document id
sorts first. Equal ids are ordered by their text. An empty table gives files
without rows. Only id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.llm.texts import UnitTable, fields, sum_by, text_chunks
from factlake.operators.scale import scratch_path

BLOCK_BITS = 512
SEGMENT_TOKENS = 1 << 20
ROWS_PER_KEY = 10_000
CUT_CHARS = 200


# ---- codes ----------------------------------------------------------------


def pack(ids: np.ndarray) -> bytes:
    """Codes of unsigned 32-bit ids."""
    rest = np.asarray(ids, np.uint32)
    head, body = [len(rest)], []
    while True:
        more = rest > 0xFF
        body.append((rest & 0xFF).astype(np.uint8).tobytes())
        if not more.any():
            break
        bits = np.zeros(-(-len(rest) // BLOCK_BITS) * BLOCK_BITS // 8, np.uint8)
        packed = np.packbits(more, bitorder="little")
        bits[: len(packed)] = packed
        ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, 8).sum(1, dtype=np.uint32)
        body += [bits.tobytes(), (np.cumsum(ones, dtype=np.uint32) - ones).tobytes()]
        rest = rest[more] >> 8
        head.append(len(rest))
    return np.array([len(head), *head], "<u4").tobytes() + b"".join(body)


class Codes:
    """Random access to packed ids."""

    def __init__(self, blob: bytes) -> None:
        levels = int(np.frombuffer(blob, "<u4", 1)[0])
        sizes = np.frombuffer(blob, "<u4", levels, 4).tolist()
        at = 4 * (1 + levels)
        self.chunks, self.bits, self.ranks = [], [], []
        for k, n in enumerate(sizes):
            self.chunks.append(np.frombuffer(blob, np.uint8, n, at))
            at += n
            if k + 1 < levels:
                blocks = -(-n // BLOCK_BITS)
                self.bits.append(np.frombuffer(blob, np.uint8, blocks * 64, at))
                at += blocks * 64
                self.ranks.append(np.frombuffer(blob, "<u4", blocks, at))
                at += blocks * 4

    def __len__(self) -> int:
        return len(self.chunks[0])

    def _rank(self, level: int, i: np.ndarray) -> np.ndarray:
        """Set bits of the level's bitmap before the places i."""
        block, bits = i // BLOCK_BITS, self.bits[level]
        inside = np.minimum(block, len(self.ranks[level]) - 1)
        out = self.ranks[level][inside].astype(np.int64)
        for byte in range(BLOCK_BITS // 8):
            full = i - inside * BLOCK_BITS - 8 * byte
            mask = (1 << np.clip(full, 0, 8)) - 1
            out += np.bitwise_count(bits[inside * 64 + byte] & mask.astype(np.uint8))
        return out

    def get(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places."""
        i = np.asarray(places, np.int64)
        if len(i) and (i.min() < 0 or i.max() >= len(self)):
            raise IndexError("no such token")
        out = np.zeros(len(i), np.uint32)
        who = np.arange(len(i))
        for k, chunks in enumerate(self.chunks):
            out[who] |= chunks[i].astype(np.uint32) << np.uint32(8 * k)
            if k < len(self.bits):
                more = (self.bits[k][i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1
                who, i = who[more], self._rank(k, i[more])
        return out

    def span(self, lo: int, hi: int) -> np.ndarray:
        """The ids at the places lo..hi - 1."""
        out = np.zeros(hi - lo, np.uint32)
        who = slice(None)
        for k, chunks in enumerate(self.chunks):
            if hi <= lo:
                break
            out[who] |= chunks[lo:hi].astype(np.uint32) << np.uint32(8 * k)
            if k < len(self.bits):
                first = lo >> 3
                bits = np.unpackbits(self.bits[k][first : -(-hi // 8)], bitorder="little")
                more = np.flatnonzero(bits[lo - 8 * first : hi - 8 * first])
                who = more if k == 0 else who[more]
                lo = int(self._rank(k, np.array([lo]))[0])
                hi = lo + len(more)
        return out


# ---- ids ------------------------------------------------------------------

# The normaliser and splitter for which words are independent.
WORD_NORMALIZER = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"


class WordEncoder:
    """Ids of whole texts by the tokenizers library, without added tokens.

    A vocabulary that drops white space, never merges across it and puts an end
    mark on every word's last piece is asked only for words that are not
    remembered; texts in plain Latin-1 are cut further, between letters and
    other characters. Any other vocabulary gets whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        parts = (spec["normalizer"] or {}).get("normalizers", [])
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_word = (
            [p["type"] for p in parts] == WORD_NORMALIZER
            and splits[0].get("pattern") == {"Regex": WORD_PATTERN}
            and splits[0].get("behavior") == "Removed"
            and spec["model"].get("end_of_word_suffix") == "</w>"
        )
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words = re.compile(r"[^\x20\x09-\x0D]+")
        self.fine = re.compile(rf"[{LATIN}]+|[^\s{LATIN}]+")
        self.letters = re.compile(rf"[{LATIN}]+")
        # contractions, special tokens, and what is space or letter elsewhere
        self.coarse = re.compile("['\x1c-\x1f\x85\xa0ªµº]|<\\|")
        self.table = UnitTable(self._encode)

    def _each(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(units, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = [i for ids in found for i in ids]
        return np.array(flat, np.int32), sizes

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters only are asked for in lines of many, cut at the
        end marks."""
        plain = [i for i, u in enumerate(units) if self.letters.fullmatch(u)]
        if not plain:
            return self._each(units)
        lines = [" ".join(units[i] for i in plain[a : a + 500]) for a in range(0, len(plain), 500)]
        ids, _ = self._each(lines)
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(plain) or ends[-1] + 1 != len(ids):
            return self._each(units)
        rest = sorted(set(range(len(units))) - set(plain))
        other, other_sizes = self._each([units[i] for i in rest])
        sizes = np.zeros(len(units), np.int64)
        sizes[plain] = np.diff(ends, prepend=-1)
        sizes[rest] = other_sizes
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int32)
        mask = np.zeros(len(units), bool)
        mask[plain] = True
        of_plain = np.repeat(mask, sizes)
        out[of_plain], out[~of_plain] = ids, other
        return out, sizes

    def _split(self, text: str) -> list[str]:
        if self.coarse.search(text):
            return self.words.findall(text)
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.words.findall(text)
        return self.fine.findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        if not self.by_word:
            return self._each(texts)
        at, counts = self.table.find([self._split(t) for t in texts])
        return self.table.ids(at), sum_by(counts, self.table.sizes(at))


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# ---- files ----------------------------------------------------------------


def write_tokens(
    df: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    segment_tokens: int = SEGMENT_TOKENS,
    rows_per_key: int = ROWS_PER_KEY,
) -> None:
    """Write the ids of every text, each with `end_id` behind it, in ascending
    order of `key`, rows of one key by text. A segment ends with the document
    that fills it. If a key has more than `rows_per_key` rows, ranges may cut
    keys by the beginning of texts, so that rows without a key are many tasks."""
    kind = dict(df.select(key).dtypes)[key]
    out = (
        "shard int, segment int, shard_start bigint, n_tokens bigint, "
        f"keys array<{kind}>, sizes array<bigint>, codes binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, start = TaskContext.get().partitionId(), 0, 0
        keys, sizes, parts, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal segment, start, keys, sizes, parts, held
            values = {
                "shard": pa.array([shard], pa.int32()),
                "segment": pa.array([segment], pa.int32()),
                "shard_start": pa.array([start], pa.int64()),
                "n_tokens": pa.array([held], pa.int64()),
                "keys": pa.array([pa.concat_arrays(keys).to_pylist()], pa.list_(keys[0].type)),
                "sizes": pa.array([np.concatenate(sizes)], pa.list_(pa.int64())),
                "codes": pa.array([pack(np.concatenate(parts))], pa.binary()),
            }
            segment, start = segment + 1, start + held
            keys, sizes, parts, held = [], [], [], 0
            return pa.RecordBatch.from_arrays(list(values.values()), names=list(values))

        for batch, texts in text_chunks(batches, "_text"):
            ids, counts = encoder(vocabulary).encode(texts)
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
            ends, first, before = np.cumsum(counts), 0, 0
            while first < len(counts):
                room = max(segment_tokens - held, 1)
                last = int(np.searchsorted(ends, before + room)) + 1
                last = min(last, len(counts))
                keys.append(batch.column(0).slice(first, last - first))
                sizes.append(counts[first:last])
                parts.append(ids[before : ends[last - 1]])
                held += int(ends[last - 1]) - before
                first, before = last, int(ends[last - 1])
                if held >= segment_tokens:
                    yield row()
        if keys:
            yield row()

    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")
    known = F.col(key).asc_nulls_first()
    # Only the rows of a hot key need their texts to be told apart
    hot = not df.groupBy(key).count().filter(F.col("count") > rows_per_key).isEmpty()
    ranges = [known, F.substring("_text", 1, CUT_CHARS)] if hot else [known]
    if hot:  # a given number: small ranges would be put together again
        ranges.insert(0, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.select(F.col(key), whole).repartitionByRange(*ranges).sortWithinPartitions(known, "_text")
    ordered.mapInArrow(run, out).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """All segments with `start`, the number of tokens in all segments before.

    Only the ranges' totals (one row for each task that wrote) are added up in
    one place; the sum inside a range was stored as it was written.
    """
    segments = spark.read.parquet(path)
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    start = F.col("_base") + F.col("shard_start")
    return segments.join(F.broadcast(base), "shard").withColumn("start", start).drop("_base")


def read_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """`key`, start, n_tokens, ids of every document in the files."""
    segments = read_segments(spark, path)
    kind = dict(segments.dtypes)["keys"][len("array<") : -1]
    out = f"`{key}` {kind}, start bigint, n_tokens bigint, ids array<bigint>"

    def run(batches):
        for batch in batches:
            for keys, starts, sizes, ids in _documents(batch):
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(starts), pa.array(sizes),
                     pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))],
                    names=[key, "start", "n_tokens", "ids"],
                )

    return segments.select("keys", "start", "sizes", "codes").mapInArrow(run, out)


def digest(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """`key`, start, n_tokens and ids_crc32 of every document in the files."""
    segments = read_segments(spark, path)
    kind = dict(segments.dtypes)["keys"][len("array<") : -1]
    out = f"`{key}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches):
        for batch in batches:
            for keys, starts, sizes, ids in _documents(batch):
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = 4 * np.cumsum(sizes)
                sums = [crc32(raw[a:b]) for a, b in zip((ends - 4 * sizes).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(starts), pa.array(sizes), pa.array(sums, pa.int64())],
                    names=[key, "start", "n_tokens", "ids_crc32"],
                )

    return segments.select("keys", "start", "sizes", "codes").mapInArrow(run, out)


def _documents(batch: pa.RecordBatch):
    """Keys, starts, sizes and ids of the documents of each segment."""
    for i in range(batch.num_rows):
        keys = batch.column(0)[i].values
        sizes = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
        starts = batch.column(1)[i].as_py() + np.cumsum(sizes) - sizes
        codes = Codes(batch.column(3)[i].as_buffer())
        yield keys, starts, sizes, codes.span(0, len(codes))


def token_path(spark: SparkSession) -> str:
    return scratch_path(spark, "tokens")
