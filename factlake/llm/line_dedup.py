"""Removal of repeated lines by an exact set-similarity join.

A line is the set of its words (ASCII letters lower-cased). It is removed if
an earlier line, in (document id, line number) order, has a Jaccard similarity
of at least `threshold` with it. That is decided for every line by itself, so
the result does not depend on the order of the work.

1. Words are counted into a table of `SLOTS` sums, the only thing that is
   broadcast. It defines one order of all words, rare ones first; words whose
   slots tie are ordered by their hash. The order decides speed only.
2. Lines with equal word sets are one class, represented by its first line.
3. Prefix filter: sets of size n that reach the threshold share one of their
   n - ceil(threshold * n) + 1 rarest words. Classes meet by these words; pairs
   must pass the length filter, the positional filter (enough words are left
   behind the shared one) and a bitmap filter (parities of word hashes differ
   in no more places than the sets may differ in words).
4. In each group a line keeps its `CLOSEST` nearest earlier candidates by
   bitmap; they are verified on whole word sets. Lines that had more
   candidates, none of which held, are done again with all of them.
A word that is shared by more than `BLOCK` classes has its group cut into
blocks, and every two blocks meet in a task of their own.

Words are 64-bit hashes, classes 128-bit sums of them. Lines without a word
stay. Null text counts as empty. Null ids come last, each row a document of its
own; rows of one id are documents of their own too, in the order of their
texts' md5. Only copies, with one id and one text, are one document.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.texts import fresh, ragged, release, text_chunks
from factlake.operators.scale import dense_index, has_at_most, materialize

THRESHOLD = 0.8
SLOTS = 1 << 18
CLOSEST = 16
BLOCK = 16_384
GROUP_ROWS = 50_000
# Pairs that a group holds beside each line's nearest.
HELD_PAIRS = 500_000
CHUNK = 500_000
BROADCAST_LINES = 1_000_000
HOT = 1 << 30
LAST = (1 << 63) - 1
PLACE_BITS = 30
# Bits of the sketches that pairs of long sets are compared by first
SKETCH = 4096


# ---- words ------------------------------------------------------------------

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray, add: int) -> np.ndarray:
    """Well mixed numbers, so that sums of them tell sets apart."""
    x = x + np.uint64(add)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str], run: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and its line, counted over all texts.
    Words are hashed eight bytes at a time, all words at once. With `run`, of
    every run of so many words of a line, or of all if it has fewer."""
    raw = "\n".join(texts).encode().lower() + bytes(8)
    n = len(raw) - 8
    letters = np.frombuffer(raw, np.uint8, n)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~BLANK[letters]
    border = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = border[0::2], border[1::2] - border[0::2]
    line = np.cumsum(letters == 0x0A, dtype=np.int32)[starts] if len(starts) else starts
    eight = np.ndarray(n + 1, "<u8", raw, 0, (1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    hashes = mixed(sizes.astype(np.uint64), 0x9E3779B97F4A7C15)
    who, done = np.arange(len(starts)), 0
    while len(who):
        left = sizes[who] - done
        part = eight[starts[who] + done] & masks[np.minimum(left, 8)]
        hashes[who] = mixed(hashes[who] ^ part, 0x2545F4914F6CDD1D)
        who, done = who[left > 8], done + 8
    return runs_of(hashes, line.astype(np.int64), run)


def runs_of(hashes: np.ndarray, line: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `run` words, from the words' hashes."""
    n, out = len(line), hashes.copy()
    whole = np.ones(n, bool)
    for k in range(1, run):
        whole[max(n - k, 0) :] = False
        whole[: max(n - k, 0)] = line[k:] == line[: max(n - k, 0)]
        at = np.flatnonzero(whole)
        out[at] = mixed(out[at] ^ hashes[at + k], 0x9E3779B97F4A7C15)
    keep = whole
    keep[:1] = True
    keep[1:] |= line[1:] != line[:-1]
    return out[keep], line[keep]


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def count_words(texts: DataFrame, run_words: int = 1) -> np.ndarray:
    """How often the words of each slot stand in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SLOTS, np.int64)
        for _, chunk in text_chunks(batches, "_text", CHUNK):
            sums += np.bincount(slot(word_hashes(chunk, run_words)[0]), minlength=SLOTS)
        some = np.flatnonzero(sums)
        for first in range(0, len(some), 50_000):
            part = some[first : first + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[part])], names=["slot", "n"])

    counted = texts.select("_text").mapInArrow(run, "slot bigint, n bigint")
    found = counted.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros(SLOTS, np.int64)
    sums[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return sums


def word_sets_of(texts: list[str], rank: np.ndarray | None = None, run_words: int = 1):
    """Lines with a word, the size of each one's word set, and the sets' hashes
    one after the other: by the rank of their slots, then by hash."""
    hashes, line = word_hashes(texts, run_words)
    ranks = rank[slot(hashes)] if rank is not None else np.zeros(len(line), np.int64)
    # One number to sort by; exact unless two words of a line agree in it
    low = (hashes >> np.uint64(39)).astype(np.int64)
    order = np.argsort((line << 44) | (ranks << 25) | low) if not len(line) or line[-1] < 1 << 19 else None
    if order is not None and len(order) > 1:
        x, y = order[:-1], order[1:]
        tie = (line[x] == line[y]) & (ranks[x] == ranks[y]) & (low[x] == low[y])
        if (hashes[x[tie]] != hashes[y[tie]]).any():
            order = None
    if order is None:
        order = np.lexsort((hashes, low, ranks, line))
    hashes, line = hashes[order], line[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
    numbers, sizes = np.unique(line[new], return_counts=True)
    return numbers, sizes, hashes[new]


# ---- lines ------------------------------------------------------------------


def least_overlap(a, b, threshold: float):
    """Common words that sets of a and b words need."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9).astype(np.int64)


def is_wide(size: np.ndarray, threshold: float) -> np.ndarray:
    """Sets that may differ in more words than the 128 bits of unrelated sets
    differ in: a bitmap tells nothing about them, and none is kept."""
    return 2 * (size - least_overlap(size, size, threshold)) >= 72


def describe_lines(
    texts: DataFrame, sums: np.ndarray, threshold: float, run_words: int = 1
) -> DataFrame:
    """A row for every line with a word: its place, class, size, bitmap and
    the keys of its prefix, rarest word first. A key is 30 bits of a word's
    hash; HOT is added if the word may be in more than BLOCK classes."""
    # Slots by how full they are
    order = np.argsort(sums, kind="stable")
    rank = np.empty(SLOTS, np.int64)
    rank[order] = np.arange(SLOTS)
    shared = texts.sparkSession.sparkContext.broadcast((rank, sums > BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, frequent = shared.value
        for batch, chunk in text_chunks(batches, "_text", CHUNK):
            numbers, sizes, hashes = word_sets_of(chunk, rank, run_words)
            if not len(numbers):
                continue
            starts = np.cumsum(sizes) - sizes
            bit = np.uint64(1) << ((hashes >> np.uint64(57)) & np.uint64(63))
            upper = hashes >> np.uint64(63) == 1
            bits = [np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), starts) for x in (~upper, upper)]
            bits = [np.where(is_wide(sizes, threshold), np.uint64(0), b) for b in bits]
            prefix = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
            # A set that only its equals can match needs no keys
            alone = least_overlap(sizes, sizes + 1, threshold) > sizes
            alone &= least_overlap(sizes, sizes - 1, threshold) > sizes - 1
            prefix[alone & (least_overlap(sizes, sizes, threshold) >= sizes)] = 0
            first = hashes[ragged(starts, prefix)]
            keys = ((first >> np.uint64(20)) & np.uint64(HOT - 1)).astype(np.int32)
            keys[frequent[slot(first)]] += HOT
            offsets = np.concatenate([[0], np.cumsum(prefix)]).astype(np.int32)
            lines = np.fromiter((t.count("\n") + 1 for t in chunk), np.int64, len(chunk))
            ends = np.cumsum(lines)
            row = np.searchsorted(ends, numbers, "right")
            columns = [
                batch.column(0).take(pa.array(row)),
                pa.array(numbers - (ends - lines)[row]),
                pa.array(np.add.reduceat(mixed(hashes, 0x9E3779B9), starts).view(np.int64)),
                pa.array(np.add.reduceat(mixed(hashes, 0x7F4A7C15F39CC060), starts).view(np.int64)),
                pa.array(sizes),
                *(pa.array(b.view(np.int64)) for b in bits),
                pa.ListArray.from_arrays(offsets, pa.array(keys)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=LINE)

    return texts.mapInArrow(
        run,
        "doc bigint, line bigint, h1 bigint, h2 bigint, size bigint, bits bigint, "
        "bits2 bigint, keys array<int>",
    )


LINE = ["doc", "line", "h1", "h2", "size", "bits", "bits2", "keys"]


# ---- candidates -------------------------------------------------------------

Y, X = ["y_doc", "y_line"], ["x_doc", "x_line"]


def _meet(threshold: float, closest: int | None):
    """Rows of groups in; pairs (later, earlier) that may be similar out. With
    `closest`, each line's nearest ones only, `more` telling of others; without
    it, all of the lines that are `wanted`."""

    def groups(rows: pa.Table) -> np.ndarray:
        """Columns that tell groups apart."""
        names = [n for n in ("block_a", "block_b") if n in rows.column_names]
        return np.stack([rows["kp"].to_numpy() >> PLACE_BITS, *(rows[n].to_numpy() for n in names)])

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        own = groups(rows)
        size = rows["ls"].to_numpy() & ((1 << 32) - 1)
        order = np.lexsort((size, *own[::-1]))
        own, size = own[:, order], size[order]
        new = np.ones(len(order), bool)
        new[1:] = (own[:, 1:] != own[:, :-1]).any(0)
        group = np.cumsum(new)
        place = (rows["kp"].to_numpy() & ((1 << PLACE_BITS) - 1))[order]
        bits = np.stack([rows[n].to_numpy().view(np.uint64)[order] for n in ("bits", "bits2")])
        wide = is_wide(size, threshold)
        doc, line = rows["doc"].to_numpy()[order], (rows["ls"].to_numpy() >> 32)[order]
        half = rows["half"].to_numpy()[order] if "half" in rows.column_names else None
        wanted = rows["wanted"].to_numpy(zero_copy_only=False)[order] if closest is None else None
        seen = np.zeros(len(order), np.int32)

        def nearest(pairs: list[np.ndarray]) -> np.ndarray:
            """(later, earlier, bits apart) of each line's nearest candidates."""
            later, earlier, apart = np.concatenate(pairs, 1)
            by = np.lexsort((line[earlier], doc[earlier], apart, later))
            later = later[by]
            near = np.arange(len(by)) - np.searchsorted(later, later) < closest
            return np.stack([later, earlier[by], apart[by]])[:, near]

        def shown(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
            for first in range(0, pairs.shape[1], 50_000):
                y, x, apart = pairs[:, first : first + 50_000]
                more = seen[y] > closest if closest else np.zeros(len(y), bool)
                columns = [doc[y], line[y], doc[x], line[x], apart, more]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*Y, *X, "apart", "more"])

        held, waiting = [np.zeros((3, 0), np.int64)], 0
        a, step = np.arange(len(order)), 1
        while len(a):
            a = a[a + step < len(order)]
            b = a + step
            near = (group[a] == group[b]) & (size[a] >= threshold * size[b] - 1e-9)
            a, b = a[near], b[near]
            need = least_overlap(size[a], size[b], threshold)
            left = 1 + np.minimum(size[a] - place[a] - 1, size[b] - place[b] - 1)
            differ = np.bitwise_count(bits[:, a] ^ bits[:, b]).sum(0, dtype=np.int64)
            differ[wide[a] | wide[b]] = 0
            ok = (left >= need) & (differ <= size[a] + size[b] - 2 * need)
            # Two words of one line may have the same key
            ok &= (doc[a] != doc[b]) | (line[a] != line[b])
            if half is not None:  # rows of one block meet where both blocks are the same
                ok &= (half[a] != half[b]) | (own[1, a] == own[2, a])
            x, y = a[ok], b[ok]
            after = (doc[x] > doc[y]) | ((doc[x] == doc[y]) & (line[x] > line[y]))
            later, earlier = np.where(after, x, y), np.where(after, y, x)
            seen += np.bincount(later, minlength=len(seen)).astype(np.int32)
            part = np.stack([later, earlier, differ[ok]])
            held.append(part if wanted is None else part[:, wanted[later]])
            waiting += held[-1].shape[1]
            if waiting > HELD_PAIRS:
                if closest is None:
                    yield from shown(np.concatenate(held, 1))
                    held = []
                else:
                    held = [nearest(held)]
                waiting = 0
            step += 1
        if held:
            yield from shown(np.concatenate(held, 1) if closest is None else nearest(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < GROUP_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            own = groups(rows)
            whole = int((own != own[:, -1:]).any(0).sum())
            held = rows.slice(whole).combine_chunks().to_batches()
            if whole:
                yield from pairs(rows.slice(0, whole))
        if held:
            yield from pairs(pa.Table.from_batches(held))
        release()

    return run


def line_classes(lines: DataFrame) -> DataFrame:
    """A row for each class: its first line, and how many lines it has."""
    first = F.min(F.struct("doc", "line", "size", "bits", "bits2", "keys")).alias("_f")
    found = lines.groupBy("h1", "h2").agg(first, F.count("*").alias("n"))
    return found.select("h1", "h2", "n", "_f.*")


def prefix_rows(classes: DataFrame) -> DataFrame:
    """A row for each key of each class's first line: its document, ls (line
    and size in one number), bitmap, and kp (key and place in the prefix)."""
    ls = F.shiftleft("line", 32).bitwiseOR(F.col("size")).alias("ls")
    parts = classes.select("doc", ls, "bits", "bits2", F.posexplode("keys").alias("_place", "_key"))
    kp = F.shiftleft(F.col("_key").cast("bigint"), PLACE_BITS).bitwiseOR(F.col("_place").cast("bigint"))
    return parts.select("doc", "ls", "bits", "bits2", kp.alias("kp"))


def candidates(rows: DataFrame, threshold: float, closest: int | None) -> DataFrame:
    """Distinct pairs of lines that passed all filters."""
    key = F.shiftright("kp", PLACE_BITS)
    hot = rows.filter(F.col("kp") >= HOT << PLACE_BITS).groupBy(key.alias("_key")).count()
    blocks = F.ceil(F.col("count") / BLOCK).cast("int").alias("_blocks")
    hot = materialize(hot.filter(F.col("count") > BLOCK).select("_key", blocks), "hot-words")
    if hot.isEmpty():
        dealt = rows.repartition(key).sortWithinPartitions("kp")
    else:
        small = F.broadcast(hot) if has_at_most(hot, 100_000) else hot
        keyed = rows.withColumn("_key", key)
        own = F.pmod(F.xxhash64("doc", "ls"), F.col("_blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
        cells = keyed.join(small, "_key").withColumn("half", own).withColumn("_j", other)
        a, b = F.least("half", "_j").alias("block_a"), F.greatest("half", "_j").alias("block_b")
        none = F.lit(-1).cast("int")
        alone = keyed.join(small, "_key", "left_anti").select(
            *rows.columns, none.alias("block_a"), none.alias("block_b"), none.alias("half")
        )
        dealt = alone.unionByName(cells.select(*rows.columns, a, b, "half"))
        dealt = dealt.repartition(key, "block_a", "block_b")
        dealt = dealt.sortWithinPartitions(key, "block_a", "block_b")
    out = ", ".join(f"{n} bigint" for n in [*Y, *X, "apart"]) + ", more boolean"
    pairs = dealt.mapInArrow(_meet(threshold, closest), out)
    return pairs.groupBy(*Y, *X).agg(F.min("apart").alias("apart"), F.max("more").alias("more"))


def word_sets(texts: DataFrame, wanted: DataFrame, run_words: int = 1, sketch: bool = False) -> DataFrame:
    """(doc, line, words) of the wanted lines (doc, line): their hashes. Or
    (doc, line, size, sketch)."""
    wanted = materialize(wanted, "wanted-lines")
    lists = wanted.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("_lines"))
    if has_at_most(wanted, BROADCAST_LINES):
        lists = F.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in text_chunks(batches, "_text", CHUNK):
            own, docs, places = [], [], []
            for doc, text, at in zip(batch.column(0).to_pylist(), chunk, batch.column(2).to_pylist()):
                lines = text.split("\n")
                at = [i for i in at if i < len(lines)]
                own += [lines[i] for i in at]
                docs += [doc] * len(at)
                places += at
            numbers, sizes, hashes = word_sets_of(own, run_words=run_words)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            who = pa.array(numbers)
            if sketch:
                columns = [pa.array(docs, pa.int64()).take(who), pa.array(places, pa.int64()).take(who),
                           pa.array(sizes), pa.array(sketches_of(sizes, hashes), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "line", "size", "sketch"])
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()).take(who), pa.array(places, pa.int64()).take(who),
                 pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))],
                names=["doc", "line", "words"],
            )

    joined = texts.join(lists, "doc").select("doc", "_text", "_lines")
    kind = "size bigint, sketch binary" if sketch else "words array<bigint>"
    return joined.mapInArrow(run, f"doc bigint, line bigint, {kind}")


def sketches_of(sizes: np.ndarray, hashes: np.ndarray) -> list[bytes]:
    """Parities of the sets' hashes in SKETCH places: two sets differ in as
    many words as their sketches in bits, or more."""
    out, ends = [], np.cumsum(sizes)
    place = (mixed(hashes, 0x5851F42D) >> np.uint64(40)).astype(np.int64) % SKETCH
    for first in range(0, len(sizes), 256):
        some = sizes[first : first + 256]
        at = place[ends[first] - sizes[first] : ends[first + len(some) - 1]]
        at = at + np.repeat(np.arange(len(some)), some) * SKETCH
        odd = np.bincount(at, minlength=len(some) * SKETCH).reshape(-1, SKETCH) & 1
        out += [row.tobytes() for row in np.packbits(odd.astype(bool), axis=1)]
    return out


def sketched(texts: DataFrame, pairs: DataFrame, threshold: float, run_words: int) -> DataFrame:
    """The pairs with `may`: false if their sketches differ in more bits than
    similar sets differ in words. So few whole sets are sent."""
    ends = [pairs.select(*[F.col(a).alias(b) for a, b in zip(s, ("doc", "line"))]) for s in (Y, X)]
    marks = word_sets(texts, ends[0].unionByName(ends[1]).distinct(), run_words, sketch=True)
    marks = written(marks, "sketches")

    def side(names: list[str], to: str) -> DataFrame:
        renamed = [F.col(a).alias(b) for a, b in zip(("doc", "line"), names)]
        return marks.select(*renamed, F.col("size").alias(f"{to}_size"), F.col("sketch").alias(to))

    few = has_at_most(pairs, BROADCAST_LINES // 10)
    whole = side(Y, "_y").join(F.broadcast(pairs) if few else pairs, Y).join(side(X, "_x"), X)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            bits = [np.frombuffer(b"".join(batch[c].to_pylist()), np.uint64).reshape(n, -1) for c in ("_y", "_x")]
            y, x = (batch[c].to_numpy() for c in ("_y_size", "_x_size"))
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int64)
            may = apart <= y + x - 2 * least_overlap(y, x, threshold)
            columns = [*(batch[c] for c in (*Y, *X)), pa.array(apart), batch["more"], pa.array(may)]
            yield pa.RecordBatch.from_arrays(columns, names=[*Y, *X, "apart", "more", "may"])

    chosen = whole.select(*Y, *X, "more", "_y_size", "_x_size", "_y", "_x")
    out = ", ".join(f"{n} bigint" for n in [*Y, *X, "apart"]) + ", more boolean, may boolean"
    return chosen.mapInArrow(run, out)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Distinct later lines of the pairs whose Jaccard similarity holds."""

    def side(names: list[str], words: str) -> DataFrame:
        renamed = [F.col(a).alias(b) for a, b in zip(("doc", "line"), names)]
        return sets.select(*renamed, F.col("words").alias(words))

    pairs = pairs.filter("y_doc <> x_doc or y_line <> x_line").select(*Y, *X)
    # Few pairs go to the sets, which then are shuffled once instead of twice
    few = has_at_most(pairs, BROADCAST_LINES // 10)
    earlier = pairs.select(*X).distinct()
    whole = side(Y, "_y").join(F.broadcast(pairs) if few else pairs, Y)
    # Sets that are later ones only are not sent
    other = side(X, "_x").join(F.broadcast(earlier), X, "left_semi") if few else side(X, "_x")
    whole = whole.join(other, X)
    common = F.size(F.array_intersect("_y", "_x"))
    need = F.ceil(threshold / (1 + threshold) * (F.size("_y") + F.size("_x")) - 1e-9)
    return whole.filter(common >= need).select(*Y).distinct()


def written(df: DataFrame, name: str) -> DataFrame:
    """`materialize`, then let go of the shuffles behind it: Spark deletes their
    files when the driver's JVM collects the plans, which a quiet driver puts
    off until the executors' disks are full."""
    out = materialize(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


# ---- the operator -----------------------------------------------------------


def documents(df: DataFrame, key: str, text: str) -> tuple[DataFrame, str, DataFrame]:
    """All rows of `df` with the number of their document, that column's name,
    and the first row of each document, with its number. The number is the id
    (null: LAST) if no two rows would share it. Otherwise rows are written down
    once in the order of id, text, all columns and (null ids) row, and the
    number is the place of the first copy."""
    name = fresh(df, "_doc")
    known = F.col(key).cast("bigint")
    rows = df.withColumn(name, F.coalesce(known, F.lit(LAST)))
    if rows.groupBy(name).count().filter(F.col("count") > 1).isEmpty():
        return rows, name, rows
    single = F.when(known.isNull(), F.monotonically_increasing_id()).otherwise(0)
    plain = [c for c, kind in df.dtypes if "map<" not in kind]
    keyed = df.select(
        F.struct(*df.columns).alias("_row"),
        known.alias("_id"),
        F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_md5"),
        F.xxhash64(*plain).alias("_all"),
        single.alias("_no"),
    )
    order = [F.col("_id").asc_nulls_last(), F.col("_md5"), F.col("_all"), F.col("_no")]
    placed = dense_index(keyed, order, "_place")
    copies = placed.filter("_id is not null").groupBy("_id", "_md5")
    copies = copies.agg(F.min("_place").alias("_first"), F.count("*").alias("_copies"))
    copies = written(copies.filter("_copies > 1").drop("_copies"), "copies")
    few = has_at_most(copies, BROADCAST_LINES // 10)
    placed = placed.join(F.broadcast(copies) if few else copies, ["_id", "_md5"], "left")
    doc = F.coalesce("_first", "_place")
    rows = placed.select("_row.*", doc.alias(name))
    return rows, name, placed.filter(doc == F.col("_place")).select("_row.*", doc.alias(name))


def texts_of(first: DataFrame, doc: str, text: str) -> DataFrame:
    """doc and _text of the documents."""
    return first.select(F.col(doc).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))


def removed_lines(
    texts: DataFrame, threshold: float = THRESHOLD, closest: int = CLOSEST, run_words: int = 1
) -> tuple[DataFrame, DataFrame]:
    """All lines with a word (doc, line, ...) of the documents (doc, _text), and
    the removed ones (doc, line, near: no earlier line has the same words). Sets
    are those of runs of `run_words` words."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must lie in [0.5, 1]")
    lines = written(describe_lines(texts, count_words(texts, run_words), threshold, run_words), "lines")
    classes = written(line_classes(lines), "line-classes")
    near = near_lines(texts, classes, threshold, closest, run_words).distinct()

    # A class goes as a whole, or all but its first line
    names = [F.col(a).alias(b) for a, b in zip(Y, ("_d", "_l"))]
    found = classes.select("h1", "h2", "n", F.col("doc").alias("_d"), F.col("line").alias("_l"))
    found = found.join(near.select(*names, F.lit(True).alias("_near")), ["_d", "_l"], "left")
    found = found.filter("n > 1 or _near")
    removed = (
        lines.select("doc", "line", "h1", "h2")
        .join(found, ["h1", "h2"])
        .filter("_near or doc <> _d or line <> _l")
        .select("doc", "line", F.expr("doc = _d and line = _l").alias("near"))
    )
    return lines, removed


def near_lines(
    texts: DataFrame, classes: DataFrame, threshold: float, closest: int, run_words: int = 1
) -> DataFrame:
    """Places (y_doc, y_line) of first lines that an earlier line is similar
    to. A line's nearest candidate is verified first, the others only if that
    one does not hold, and those beyond `closest` only if none of them does."""

    def told(pairs: DataFrame) -> DataFrame:
        """Runs make long sets: which pairs may hold is told by sketches."""
        pairs = written(pairs, "line-pairs")
        if run_words == 1:
            return pairs.withColumn("may", F.lit(True))
        return written(sketched(texts, pairs, threshold, run_words), "line-pairs")

    rows = prefix_rows(classes)
    pairs = told(candidates(rows, threshold, closest))
    best = pairs.filter("may").groupBy(*Y).agg(F.min(F.struct("apart", *X)).alias("_x")).select(*Y, "_x.*")
    near = _near(texts, best, threshold, run_words)
    rest = written(pairs.join(near, Y, "left_anti"), "line-pairs")
    if rest.isEmpty():
        return near
    found = _near(texts, rest.filter("may"), threshold, run_words)
    near = near.unionByName(found)
    open_ = rest.filter("more").select(*Y).distinct().join(found, Y, "left_anti")
    open_ = written(open_.select(F.col("y_doc").alias("doc"), F.col("y_line").alias("_line")), "open-lines")
    if open_.isEmpty():
        return near
    few = has_at_most(open_, BROADCAST_LINES // 10)
    flag = open_.withColumn("wanted", F.lit(True))
    flagged = rows.withColumn("_line", F.shiftright("ls", 32))
    flagged = flagged.join(F.broadcast(flag) if few else flag, ["doc", "_line"], "left")
    flagged = flagged.withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    flagged = flagged.withColumn("_key", F.shiftright("kp", PLACE_BITS))
    keys = written(flagged.filter("wanted").select("_key").distinct(), "open-keys")
    if has_at_most(keys, BROADCAST_LINES):
        keys = F.broadcast(keys)
    flagged = flagged.join(keys, "_key", "left_semi").select(*rows.columns, "wanted")
    again = told(candidates(flagged, threshold, None))
    return near.unionByName(_near(texts, again.filter("may"), threshold, run_words))


def _near(texts: DataFrame, pairs: DataFrame, threshold: float, run_words: int) -> DataFrame:
    ends = [pairs.select(*[F.col(a).alias(b) for a, b in zip(s, ("doc", "line"))]) for s in (Y, X)]
    wanted = ends[0].unionByName(ends[1]).distinct()
    sets = written(word_sets(texts, wanted, run_words), "word-sets")
    return written(verified(pairs, sets, threshold), "near-lines")


def dedup_report(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`key`, n_lines (with a word), n_removed, n_near (those without an equal
    earlier line) and the removed line numbers, from 0, of every document."""
    rows, doc, first = documents(df, key, text)
    lines, removed = removed_lines(texts_of(first, doc, text), **options)
    counts = lines.groupBy("doc").agg(F.count("*").alias("n_lines"))
    gone = removed.groupBy("doc").agg(
        F.count("*").alias("n_removed"),
        F.sum(F.col("near").cast("bigint")).alias("n_near"),
        F.sort_array(F.collect_set("line")).alias("removed_lines"),
    )
    found = rows.select(F.col(key), F.col(doc).alias("doc")).join(counts, "doc", "left").join(gone, "doc", "left")
    numbers = [F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("n_lines", "n_removed", "n_near")]
    none = F.array().cast("array<bigint>")
    return found.select(key, *numbers, F.coalesce("removed_lines", none).alias("removed_lines"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All rows and columns of `df`, the text without its removed lines. Lines
    without a word stay; a null text stays null."""
    rows, doc, first = documents(df, key, text)
    _, removed = removed_lines(texts_of(first, doc, text), **options)
    lines = fresh(df, "_gone")
    removed = written(removed.select("doc", "line"), "removed-lines")
    gone = removed.groupBy(F.col("doc").alias(doc)).agg(F.collect_set("line").alias(lines))
    if has_at_most(removed, BROADCAST_LINES):
        gone = F.broadcast(gone)
    marked = rows.join(gone, doc, "left").select(*df.columns, lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts, lists = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for i, out in enumerate(lists):
                if out and texts[i]:
                    drop = set(out)
                    texts[i] = "\n".join(
                        x for n, x in enumerate(texts[i].split("\n")) if n not in drop
                    )
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return marked.mapInArrow(run, df.schema)
