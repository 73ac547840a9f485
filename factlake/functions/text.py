"""Column functions over article text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's Unicode \s leaves out the four separators \x1c-\x1f, which count as
# white space in the semantics we follow, so every class names them.
_SPACE = r"\s\x1c-\x1f"
SPACES = rf"(?U)[{_SPACE}]+"
URL = rf"(?U)http[^{_SPACE}]+"
NOT_LETTER = rf"(?U)[^a-z{_SPACE}]"
# Java's Unicode \w also takes combining marks, which are no word characters here.
TERM = r"[\p{L}\p{N}_]{2,}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and use it in `body`, so that a costly expression is
    not worked out again for each use inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def compose_content(title: Column, text: Column) -> Column:
    """Classifier input: title, one space, text; nulls count as empty."""
    return F.concat(_blank(title), F.lit(" "), _blank(text))


def compose_document(title: Column, text: Column) -> Column:
    """Retrieval document: title, blank line, text; nulls count as empty."""
    return F.concat(_blank(title), F.lit("\n\n"), _blank(text))


def compose_query(title: Column, text: Column) -> Column:
    """Query text: the text alone when there is no title."""
    return F.when(title.isNull(), text).otherwise(
        F.concat(title, F.lit("\n\n"), text)
    )


def clean_text(c: Column) -> Column:
    """Lower case, without URLs, only a-z and single spaces, trimmed."""
    c = F.regexp_replace(F.lower(c), URL, "")
    c = F.regexp_replace(c, NOT_LETTER, "")
    return F.trim(F.regexp_replace(c, SPACES, " "))


def head_chars(c: Column, n: int = 1000) -> Column:
    return F.substring(c, 1, n)


def strip_nul(c: Column) -> Column:
    return F.translate(c, "\u0000", "")


def words(c: Column) -> Column:
    """Words between runs of white space; blank text has none."""
    return F.filter(F.split(c, SPACES), lambda w: w != "")


def rejoin_words(c: Column, start: int, count: int) -> Column:
    """`count` words from 0-based `start`, joined by single spaces."""
    return F.array_join(F.slice(words(c), start + 1, count), " ")


def terms(c: Column) -> Column:
    """Runs of two or more word characters."""
    return F.regexp_extract_all(c, F.lit(TERM), F.lit(0))


def tally(items: Column) -> Column:
    """Array of structs (item, n): every distinct item of an array with the
    number of times it occurs. Counting inside the row needs no shuffle."""

    def runs(s: Column) -> Column:
        at = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        counted = let(
            at,
            lambda a: F.transform(
                a,
                lambda i, j: F.struct(
                    F.get(s, i).alias("item"),
                    (F.coalesce(F.get(a, j + 1), F.size(s)) - i).alias("n"),
                ),
            ),
        )
        return F.when(F.size(s) > 0, counted)

    return let(F.sort_array(items), runs)


def sliding_windows(c: Column, size: int = 256, overlap: int = 64) -> Column:
    """All word windows of a text: one for every start below the word count,
    so the last may lie inside the one before it. Blank text has none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must lie in [0, size)")
    step = size - overlap

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 1, F.lit(step))
        cut = F.transform(
            starts, lambda s: F.array_join(F.slice(w, s + 1, F.lit(size)), " ")
        )
        return F.when(F.size(w) > 0, cut)

    return let(words(c), windows)


def window_count(c: Column, size: int = 256, overlap: int = 64) -> Column:
    step = size - overlap
    return F.ceil(F.size(words(_blank(c))) / F.lit(step)).cast("int")
