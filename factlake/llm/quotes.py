"""Conversations in reply order, linked by quotations.

A message is cut into its own text and quoted passages: lines that begin with
one or more `>` marks, one passage per run of lines of one level, with the
line that announces a quote (`... wrote:`) taken away. Passages, their
paragraphs and their lines are normalised (lower case, single blanks) and
hashed; so are the own text of every message, its paragraphs and its lines. A
hash is looked up in the same conversation, at the earliest message whose own
text has it, so a popular sentence is one row per conversation, however many
quote it. A message answers the message that its shallowest linked level
quotes most characters of (ties: the later message); deeper levels name the
messages before. Only messages of earlier turns are linked.

Order: messages that answer nothing stand at the top in turn order; behind
each come the messages that answer it, directly or not, by depth, then turn.
Roots and depths are found by pointer doubling over written tables. Positions
are counted in sorted ranges that may cut a conversation, so a conversation of
any size is spread over tasks.

Null text is an empty message. Messages with a null conversation or turn are
kept and linked to nothing; null conversations are listed together. Repeated
(conversation, turn) rows share their parent. A null role is `unknown`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.llm.texts import text_chunks
from factlake.operators.scale import materialize

MARK = re.compile(r"^((?:[ \t]?>)+)[ \t]?")
ANNOUNCED = re.compile(r"(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$", re.IGNORECASE)
DEEPEST = 60


# ---- parsing ----------------------------------------------------------------


def quoted_lines(text: str) -> list[tuple[int, str]]:
    """(level, rest of the line) of every line; level 0 is own text."""
    out: list[tuple[int, str]] = []
    for line in text.split("\n"):
        mark = MARK.match(line)
        level = mark[1].count(">") if mark else 0
        if level > (out[-1][0] if out else 0) and out and ANNOUNCED.search(out[-1][1]):
            out.pop()
        out.append((level, line[mark.end() :] if mark else line))
    return out


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """The own text, and the quoted passages as (level, lines)."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for level, line in quoted_lines(text):
        if level == 0:
            own.append(line)
        elif level == before:
            passages[-1][1].append(line)
        else:
            passages.append((level, [line]))
        before = level
    return "\n".join(own).strip(), passages


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def keys(lines: list[str]) -> dict[int, int]:
    """Hash and length of a passage, of its paragraphs and of its lines."""
    from xxhash import xxh3_64_intdigest

    paragraphs, part = [], []
    for line in [*lines, ""]:
        if line.strip():
            part.append(line)
        elif part:
            paragraphs.append(" ".join(part))
            part = []
    texts = {normalised(x) for x in (" ".join(lines), *paragraphs, *lines)} - {""}
    return {xxh3_64_intdigest(t.encode()) - (1 << 63): len(t) for t in texts}


def parse_messages(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """A row per message with its own text, the keys of it, and the keys of
    its quoted passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "_text"):
            bodies, own, quoted, counts = [], [], [], []
            for t in texts:
                body, passages = parse(t)
                bodies.append(body)
                counts.append(len(passages))
                own.append([{"hash": h, "chars": n} for h, n in keys(body.split("\n")).items()])
                quoted.append([
                    {"passage": i, "level": level, "hash": h, "chars": n}
                    for i, (level, lines) in enumerate(passages)
                    for h, n in keys(lines).items()
                ])
            number = pa.int64()
            key = [pa.field("hash", number), pa.field("chars", number)]
            place = [pa.field("passage", number), pa.field("level", number)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(bodies), pa.array(counts, number),
                 pa.array(own, pa.list_(pa.struct(key))),
                 pa.array(quoted, pa.list_(pa.struct(place + key)))],
                names=["conv", "turn", "role", "body", "n_quotes", "own", "quoted"],
            )

    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")
    given = df.select(
        F.col(conversation).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"), whole,
    )
    return given.mapInArrow(
        run,
        "conv bigint, turn bigint, role string, body string, n_quotes bigint, "
        "own array<struct<hash:bigint,chars:bigint>>, "
        "quoted array<struct<passage:bigint,level:bigint,hash:bigint,chars:bigint>>",
    )


# ---- links ------------------------------------------------------------------


def reply_links(parsed: DataFrame) -> DataFrame:
    """(conv, turn, parent, n_linked) of every message that answers another."""
    known = parsed.filter("conv is not null and turn is not null")
    quotes = known.filter("size(quoted) > 0").select("conv", "turn", F.inline("quoted"))
    quoting = quotes.select("conv").distinct()
    sources = known.join(quoting, "conv", "left_semi").select("conv", "turn", F.inline("own"))
    first = sources.groupBy("conv", "hash", "chars").agg(F.min("turn").alias("parent"))
    found = quotes.join(first, ["conv", "hash", "chars"]).filter("parent < turn")
    # the longest linked part of each passage counts
    by_passage = found.groupBy("conv", "turn", "passage", "level").agg(
        F.max(F.struct("chars", "parent")).alias("best")
    )
    by_parent = by_passage.groupBy("conv", "turn", "level", F.col("best.parent").alias("parent")).agg(
        F.sum("best.chars").alias("chars"), F.count("*").alias("passages")
    )
    chosen = F.max(F.struct((-F.col("level")).alias("_level"), "chars", "parent"))
    return by_parent.groupBy("conv", "turn").agg(
        chosen["parent"].alias("parent"), F.sum("passages").alias("n_linked")
    )


def roots(links: DataFrame) -> DataFrame:
    """(conv, turn, parent, n_linked, root, depth): pointers are doubled until
    every message points to one that answers nothing."""
    up = links.withColumns({"root": F.col("parent"), "depth": F.lit(1).cast("bigint")})
    up = materialize(up, "replies")
    for _ in range(DEEPEST):
        above = up.select(
            "conv", F.col("turn").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth")
        )
        if up.join(above, ["conv", "root"], "left_semi").isEmpty():
            break
        up = up.join(above, ["conv", "root"], "left").select(
            "conv", "turn", "parent", "n_linked",
            F.coalesce("_root", "root").alias("root"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
        )
        up = materialize(up, "replies")
    return up


# ---- order ------------------------------------------------------------------


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a range, counted from 0 in every conversation."""
    part, last, n = TaskContext.get().partitionId(), object(), 0
    for batch in batches:
        places = []
        for conv in batch.column("conv").to_pylist():
            n = n + 1 if conv == last else 0
            last = conv
            places.append(n)
        columns = [*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "place"])


def reply_order(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """A row per message: conv_id, position in its conversation from 0, turn,
    role, text without quotes, reply_to, root_turn, depth, n_quotes, n_linked
    and the message as a chat turn."""
    parsed = materialize(parse_messages(df, conversation, turn, role, text), "messages")
    found = roots(reply_links(parsed))
    joined = parsed.select("conv", "turn", "role", "body", "n_quotes").join(found, ["conv", "turn"], "left")
    none = F.lit(0).cast("bigint")
    rows = joined.withColumns(
        {"root": F.coalesce("root", "turn"), "depth": F.coalesce("depth", none), "n_linked": F.coalesce("n_linked", none)}
    )
    order = ["conv", "root", "depth", "turn", "role", "body"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = ", ".join(f"`{n}` {t}" for n, t in ranged.dtypes)
    placed = materialize(ranged.mapInArrow(_number, f"{kinds}, part int, place bigint"), "ordered-messages")
    # A range's border cuts one conversation at most, so few conversations are
    # in several ranges and the table of their shifts is smaller than the
    # number of ranges.
    sizes = placed.groupBy("conv", "part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.sum("_n").over(before)).filter("_shift > 0")
    shifts = shifts.select(F.col("conv").alias("_conv"), F.col("part").alias("_part"), "_shift")
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    out = placed.join(F.broadcast(shifts), same, "left")
    safe = F.replace("body", F.lit("<|"), F.lit("< |"))
    return out.select(
        F.col("conv").alias("conv_id"),
        (F.col("place") + F.coalesce("_shift", none)).alias("position"),
        "turn", "role", F.col("body").alias("text"),
        F.col("parent").alias("reply_to"), F.col("root").alias("root_turn"), "depth", "n_quotes", "n_linked",
        F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), safe, F.lit("<|im_end|>\n")).alias("formatted"),
    )
