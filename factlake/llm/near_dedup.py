"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

Fingerprint: a text is lower-cased (A-Z only), cut into words and shingles of
four words; bit b is 1 if it is set in over half of the shingles' hashes.
Texts that agree in many shingles agree in most bits.

Covering masks: every bit place gets a vector of radius + 1 bits, not all
zero; table v (a vector that is not zero) keeps the places whose vector has an
odd product with v. For a pair that differs in at most `radius` places some v
is orthogonal to all their vectors, so the pair agrees on all places that
table v keeps: no pair within the radius is missed. Radius 4 over 64 bits
gives 31 tables of 32 places or more.

Only distinct fingerprints are put into tables. A bucket of one table is
compared pair by pair inside one task and answers with one link per
fingerprint to the smallest of its local component, never with all pairs. A
bucket above `BLOCK` fingerprints is cut into blocks and every two blocks meet
in a task of their own. Links become components by star contraction on
written tables. Documents join their fingerprint's component with hot
fingerprints (groups of exact copies) split.

A null text counts as empty. A text without words has the fingerprint zero,
linked like any other. A row without id gets its fingerprint, but no component
and no links. Rows with one id are one document: their fingerprints are
linked. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.line_dedup import documents, removed_lines, written
from factlake.llm.texts import fields, text_chunks
from factlake.operators.scale import has_at_most, materialize, skew_join

SEED = 42
SHINGLE = 4
RADIUS = 4
BITS = 64
BLOCK = 8192
BROADCAST_KEYS = 500_000


# ---- fingerprints -----------------------------------------------------------


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of `size` words (of all words if there are fewer).
    For bytes, `lower` and `split` know A-Z and ASCII white space only."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(line, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    starts = [0, *(gaps[: len(words) - size] + 1).tolist()]
    ends = [*gaps[size - 1 :].tolist(), len(line)]
    hashes = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends)]
    return np.array(hashes, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of every bit, as a signed 64-bit number."""
    counts = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part = hashes[first : first + (1 << 16)].view(np.uint8).reshape(-1, 8)
        # Bits of a byte column add up separately: 64 sums of 0/1.
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and the signed fingerprint `fp` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "_text"):
            found = [fingerprint(shingle_hashes(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.int64())], names=[key, "fp"]
            )

    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")
    return df.select(key, whole).mapInArrow(run, f"{fields(df, [key])}, fp bigint")


# ---- links ------------------------------------------------------------------


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The places that each table keeps, as signed numbers. Vectors are dealt
    out in turn, so every table keeps about the same number of places."""
    vectors = range(1, 1 << (radius + 1))
    masks = []
    for v in vectors:
        kept = [b for b in range(bits) if (vectors[b % len(vectors)] & v).bit_count() % 2]
        mask = sum(1 << b for b in kept)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def local_links(values: np.ndarray, radius: int, left: int | None = None) -> np.ndarray:
    """For every value the place of one value of its component, where values
    are linked at `radius` or fewer differing bits. With `left`, only pairs
    between the first `left` values and the others count.

    Every value is compared once, with the values that no component has yet.
    """
    bits = values.view(np.uint64)
    root = np.arange(len(values))
    side = np.zeros(len(values), np.int8)
    if left is not None:
        side[left:] = 1
    free = [np.flatnonzero(side == s) for s in (0, 1)]
    for seed in range(len(values)):
        if root[seed] != seed:
            continue
        free[side[seed]] = free[side[seed]][free[side[seed]] != seed]
        todo = [seed]
        while todo:
            i = todo.pop()
            other = side[i] if left is None else 1 - side[i]
            near = np.bitwise_count(bits[free[other]] ^ bits[i]) <= radius
            if near.any():
                found = free[other][near]
                free[other] = free[other][~near]
                root[found] = seed
                todo += found.tolist()
    return root


def _bucket_links(radius: int):
    """Rows sorted by bucket in, at most one link per value out. Rows with `half` belong to a meeting of two blocks."""

    def links(values: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = None
        if halves[0] >= 0 and halves[0] != halves[-1]:
            left = int((halves == halves[0]).sum())
        to = values[local_links(values, radius, left)]
        return np.maximum(values, to), np.minimum(values, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(rows: pa.Table) -> pa.RecordBatch:
            bucket = [rows[c].to_numpy() for c in ("table_no", "kept", "block_a", "block_b")]
            values, halves = rows["fp"].to_numpy(), rows["half"].to_numpy()
            new = np.zeros(len(values), bool)
            new[:1] = True
            for c in bucket:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(values)))
            out_a, out_b = [], []
            # Pairs are the common case: all at once
            two = starts[sizes == 2]
            near = np.bitwise_count((values[two] ^ values[two + 1]).view(np.uint64)) <= radius
            x, y = values[two[near]], values[two[near] + 1]
            out_a.append(np.maximum(x, y))
            out_b.append(np.minimum(x, y))
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                a, b = links(values[s : s + n], halves[s : s + n])
                out_a.append(a)
                out_b.append(b)
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            a, b = a[a != b], b[a != b]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch])
            # The last bucket may go on in the next batch
            last = np.ones(rows.num_rows, bool)
            for c in ("table_no", "kept", "block_a", "block_b"):
                column = rows[c].to_numpy()
                last &= column == column[-1]
            first = rows.num_rows - int(last.sum())
            held = rows.slice(first).combine_chunks().to_batches()
            if first:
                yield work(rows.slice(0, first))
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def links_within(values: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct
    `fp` at `radius` or fewer differing bits."""
    tables = [
        F.struct(F.lit(i).alias("table_no"), F.col("fp").bitwiseAND(F.lit(m)).alias("kept"))
        for i, m in enumerate(covering_masks(radius))
    ]
    keys = values.select("fp", F.explode(F.array(*tables)).alias("t")).select("fp", "t.*")
    hot = (
        keys.groupBy("table_no", "kept")
        .count()
        .filter(F.col("count") > block)
        .select("table_no", "kept", F.ceil(F.col("count") / block).cast("int").alias("_blocks"))
    )
    hot = materialize(hot, "hot-buckets")
    none = F.lit(-1)
    alone = keys.withColumns({"block_a": none, "block_b": none, "half": none})
    if not hot.isEmpty():
        by = ["table_no", "kept"]
        small = F.broadcast(hot) if has_at_most(hot, 100_000) else hot
        alone = alone.join(small, by, "left_anti")
        # Block i meets every block j: a row of block i goes to all cells with i
        own = F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
        cells = keys.join(small, by).withColumn("half", own).withColumn("_j", other)
        cells = cells.withColumns(
            {"block_a": F.least("half", "_j"), "block_b": F.greatest("half", "_j")}
        )
        alone = alone.unionByName(cells.select(*alone.columns))
    bucket = ["table_no", "kept", "block_a", "block_b"]
    dealt = alone.repartition(*bucket).sortWithinPartitions(*bucket, "half")
    return dealt.mapInArrow(_bucket_links(radius), "a bigint, b bigint").distinct()


# ---- components -------------------------------------------------------------


def components(links: DataFrame, low: str = "a", high: str = "b") -> DataFrame:
    """(node, root) for every linked node: the smallest node of its component.

    Alternates two contractions until nothing changes: every node points its
    larger neighbours to the smallest node it knows, then its smaller ones.
    Each round is a written table; neighbour minima are combined before they
    are shuffled, and a node with very many links is only ever a join key.
    """
    edges = links.select(F.greatest(low, high).alias("u"), F.least(low, high).alias("v"))
    edges = materialize(edges.filter("u <> v").distinct(), "links")
    seen = None
    while True:
        # large star: v > u moves to min(N(u), u)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(moved.filter("u <> v").distinct(), "links")
        # small star: all v < u, and u, move to min(N<(u))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(lowest.select("u", F.col("m").alias("v")))
        edges = materialize(moved.filter("u <> v").distinct(), "links")
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """`key`, fingerprint (16 hex digits) and component_id (the smallest key
    that is reachable over links) of every row."""
    prints = materialize(fingerprints(df, key, text), "fingerprints")
    known = prints.filter(F.col(key).isNotNull())
    distinct = known.groupBy("fp").agg(F.min(key).alias("_first"))
    distinct = materialize(distinct, "distinct-fingerprints")
    # Nodes are the smallest keys of the fingerprints
    near = links_within(distinct.select("fp"), radius)
    first = distinct.select("fp", "_first")
    a = first.select(F.col("fp").alias("a"), F.col("_first").alias("_u"))
    b = first.select(F.col("fp").alias("b"), F.col("_first").alias("_v"))
    links = near.join(a, "a").join(b, "b").select("_u", "_v")
    # one id with several fingerprints
    repeated = known.groupBy(key).agg(F.min("fp").alias("a"), F.max("fp").alias("_b"))
    repeated = repeated.filter("a <> _b").select(F.col(key))
    if not repeated.isEmpty():
        of = known.join(repeated, key).select(F.col(key).alias("_u"), "fp").distinct()
        links = links.unionByName(of.join(first, "fp").select("_u", F.col("_first").alias("_v")))
    roots = components(links, "_u", "_v")
    label = distinct.join(roots, F.col("_first") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "_first").alias("component_id")
    )
    named = skew_join(known, label, "fp", key)
    if not (unknown := prints.filter(F.col(key).isNull())).isEmpty():
        kind = dict(df.dtypes)[key]
        named = named.unionByName(unknown.withColumn("component_id", F.lit(None).cast(kind)))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return named.select(key, digits.alias("fingerprint"), "component_id")


def one_of_each(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    radius: int = RADIUS,
    threshold: float | None = None,
    run_words: int = 5,
) -> DataFrame:
    """Rows of `df`, unchanged, one document of each component: the first. In
    the order of `line_dedup.documents`, that is by id; rows without an id, and
    different texts of one id, are documents of their own. Only rows of one id
    and one text are one document, of which one row stays.

    With `threshold`, documents then go whose set of `run_words`-word runs has
    at least that Jaccard similarity with a document of a smaller number among
    those that are left, whether that one stays or not: of a chain of near
    copies the first stays. No pair is missed (the exact join of `line_dedup`, a
    text being one line). Texts without a word stay there."""
    _, doc, rows = documents(df, key, text)
    found = near_duplicates(rows.select(F.col(doc).alias("doc"), F.col(text).alias("_text")), "doc", "_text", radius)
    kept = _without(rows, doc, found.filter("component_id <> doc"), "later")
    if threshold is not None:
        body = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", " ")
        texts = kept.select(F.col(doc).alias("doc"), body.alias("_text"))
        kept = _without(kept, doc, removed_lines(texts, threshold, run_words=run_words)[1], "similar")
    return kept.select(*df.columns)


def _without(rows: DataFrame, doc: str, gone: DataFrame, name: str) -> DataFrame:
    """`rows` without the documents of `gone`."""
    gone = written(gone.select(F.col("doc").alias(doc)), name)
    return rows.join(F.broadcast(gone) if has_at_most(gone, BROADCAST_KEYS) else gone, doc, "left_anti")
