"""Quality rules: text statistics and a learned decision list, in DataFrame
functions only.

Statistics of a text are column expressions over its words; each word is
looked at inside its row, so nothing is shuffled. A repeated run of words is
found by sorting the hashes of all runs with their places in the row.

The list is learned by sequential covering. Statistics of labelled rows are
cut at quantiles and added up to cells (a combination of bins), two thirds of
the rows for growing and one third for pruning. A rule grows by the threshold
of the best information gain until it covers no good row, is pruned from its
end while that does not worsen (p - n) / (p + n) on the pruning rows, and is
kept if it is precise there; its rows leave, and the next rule is grown. What
comes back to the driver per step are the sums of each bin of each statistic.
The result is one ordered conditional expression with the thresholds in it.

Null text has no words: all counts are 0. Labels that are null or name no row
are ignored; of several labels of one id the lowest counts. Without labels of
both classes the list is empty and everything is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.operators.scale import materialize

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
RUN = 3
CUTS = 48
MAX_RULES = 12
MAX_CONDITIONS = 4
MIN_PRECISION = 0.9
MIN_ROWS = 10

# The statistics that rules may use: shares that do not follow from a text's
# length (the share of distinct words would: it falls in any long text).
RATIOS = {
    "symbol_share": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "word_length": ("word_chars", "n_words"),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, BLANK))


def repeat_words(words: Column, run: int = RUN) -> Column:
    """Words that stand in a run of `run` words found twice or more.

    A run's hash is shifted to make room for its place, so sorted numbers have
    equal runs side by side; a text of n words keeps 64 - log2(n) bits. What is
    found so are all repeated runs and, rarely, others, so the words themselves
    are compared in the same way among these places.
    """

    def marked(room: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - run)
        hashed = F.transform(
            places,
            lambda p: F.call_function(
                "shiftleft", F.xxhash64(*[F.get(words, p + i) for i in range(run)]), room
            ).bitwiseOR(p.cast("long")),
        )

        def same(sorted_: Column) -> Column:
            high = lambda x: F.call_function("shiftright", x, room)
            twice = F.filter(
                sorted_,
                lambda x, i: (high(x) == high(F.get(sorted_, i - 1)))
                | (high(x) == high(F.get(sorted_, i + 1))),
            )
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), room) - 1
            return let(F.transform(twice, lambda x: x.bitwiseAND(mask)), exact)

        return let(F.sort_array(hashed), same)

    def exact(places: Column) -> Column:
        runs = F.transform(
            places, lambda p: F.struct(F.array_join(F.slice(words, p.cast("int") + 1, run), " ").alias("w"), p.alias("p"))
        )

        def same(sorted_: Column) -> Column:
            twice = F.filter(
                sorted_,
                lambda x, i: (x["w"] == F.get(sorted_, i - 1)["w"]) | (x["w"] == F.get(sorted_, i + 1)["w"]),
            )
            return let(F.sort_array(F.transform(twice, lambda x: x["p"])), covered)

        return let(F.sort_array(runs), same)

    def covered(places: Column) -> Column:
        own = F.transform(
            places,
            lambda p, i: F.least(F.lit(run).cast("long"), F.coalesce(F.get(places, i + 1) - p, F.lit(run))),
        )
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(words) <= run, F.lit(0).cast("long")).otherwise(
        let(F.length(F.bin(F.size(words))), marked)
    )


def count_chars(text: Column, kind: str) -> Column:
    """Characters of a class, e.g. `0-9`."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("long")


def statistics(text: Column) -> Column:
    """One struct of counts of a text (null: empty)."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of_words(words: Column) -> list[Column]:
        return [
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeat_words(words).alias("n_repeat_words"),
        ]

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return F.struct(
        let(words(text), lambda w: F.struct(*of_words(w))).alias("words"),
        of_lines.alias("lines"),
        count_chars(text, "#*$%&|<>").alias("n_symbols"),
        count_chars(text, r"\p{Lu}").alias("n_upper"),
        count_chars(text, "!?").alias("n_marks"),
        count_chars(text, "0-9").alias("n_digits"),
    )


def measure(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, the counts and base_failed of every row, written down."""
    found = df.select(F.col(key), statistics(F.col(text)).alias("_s"))
    found = found.select(key, "_s.words.*", "_s.lines.*", "_s.n_symbols", "_s.n_upper", "_s.n_marks", "_s.n_digits")
    found = materialize(found, "text-statistics")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def ratios() -> dict[str, Column]:
    return {
        name: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
        for name, (a, b) in RATIOS.items()
    }


# ---- learning ---------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    name: str
    at_least: bool
    cut: int  # number of the threshold
    threshold: float

    def column(self) -> Column:
        value = ratios()[self.name]
        return value >= self.threshold if self.at_least else value < self.threshold

    def on_bins(self) -> Column:
        return F.col(self.name) > self.cut if self.at_least else F.col(self.name) <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """Rows that meet all conditions are dropped."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        return _all(c.column() for c in self.conditions)

    def on_bins(self) -> Column:
        return _all(c.on_bins() for c in self.conditions)

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _all(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression."""
    out = F
    for rule in rules:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def labelled_rows(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """_bad, _prune and the ratios of the rows with label 0 or 1."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy(key).agg((F.min(label) == 0).alias("_bad"))
    rows = measured.filter(F.col(key).isNotNull()).join(known, key)
    return rows.select(
        "_bad", (F.pmod(F.xxhash64(key), F.lit(3)) == 0).alias("_prune"), *[c.alias(n) for n, c in ratios().items()]
    )


def quantile_cuts(rows: DataFrame) -> dict[str, list[float]]:
    """The thresholds of each ratio: quantiles of all rows, and of the bad rows
    as well, which may be few."""
    marks = [(i + 0.5) / CUTS for i in range(CUTS)]
    picked = rows.agg(
        *[F.percentile_approx(n, marks, 2000).alias(n) for n in RATIOS],
        *[F.percentile_approx(F.when(F.col("_bad"), F.col(n)), marks, 2000).alias(f"_{n}") for n in RATIOS],
    ).first()
    return {n: sorted({*(picked[n] or []), *(picked[f"_{n}"] or [])}) for n in RATIOS}


def learn_rules(
    measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality"
) -> list[Rule]:
    """Rules for rows with label 0 among rows with label 0 or 1."""
    rows = labelled_rows(measured, labels, key, label)
    cuts = quantile_cuts(rows)
    if not any(cuts.values()):
        return []

    def binned(name: str) -> Column:
        limits = F.array(*[F.lit(float(t)) for t in cuts[name]])
        return F.size(F.filter(limits, lambda t: t <= F.col(name))).cast("int").alias(name)

    cells = rows.select("_bad", "_prune", *[binned(n) for n in RATIOS]).groupBy("_prune", *RATIOS)
    counted = cells.agg(
        F.sum(F.col("_bad").cast("long")).alias("p"), F.sum((~F.col("_bad")).cast("long")).alias("n")
    )
    left = materialize(counted, "rule-cells")

    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule = _prune(left.filter("_prune"), _grow(left.filter("not _prune"), cuts))
        if rule is None:
            break
        rules.append(rule)
        left = left.filter(~rule.on_bins())
    return rules


def _grow(cells: DataFrame, cuts: dict[str, list[float]]) -> list[Condition]:
    """Conditions in the order of their gain."""
    grown: list[Condition] = []
    while len(grown) < MAX_CONDITIONS:
        inside = cells.filter(_all(c.on_bins() for c in grown))
        pairs = ", ".join(f"'{n}', `{n}`" for n in RATIOS)
        bins = inside.selectExpr("p", "n", f"stack({len(RATIOS)}, {pairs}) as (name, bin)")
        sums = bins.groupBy("name", "bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
        best, gain = None, 1e-9
        for name in RATIOS:
            own = sorted((r["bin"], r["p"], r["n"]) for r in sums if r["name"] == name)
            p0, n0 = sum(p for _, p, _ in own), sum(n for _, _, n in own)
            if not p0 or not n0:
                return grown
            p = n = 0
            for i, (bin_, more_p, more_n) in enumerate(own[:-1]):
                p, n = p + more_p, n + more_n
                cut = own[i + 1][0] - 1  # the threshold that the next filled bin starts at
                for at_least, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    if a and (g := a * (log2(a / (a + b)) - log2(p0 / (p0 + n0)))) > gain:
                        best, gain = Condition(name, at_least, cut, cuts[name][cut]), g
        if best is None:
            return grown
        grown.append(best)
    return grown


def _prune(cells: DataFrame, grown: list[Condition]) -> Rule | None:
    """The beginning of the conditions that does best on other rows."""
    if not grown:
        return None
    heads = [_all(c.on_bins() for c in grown[: i + 1]) for i in range(len(grown))]
    zero = F.lit(0)
    sums = cells.agg(
        *[F.coalesce(F.sum(F.when(h, F.col(c))), zero) for h in heads for c in ("p", "n")]
    ).first()
    worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in zip(sums[0::2], sums[1::2])]
    best = max(range(len(worth)), key=lambda i: (worth[i], -i))
    p, n = sums[2 * best], sums[2 * best + 1]
    if p < MIN_ROWS or p < MIN_PRECISION * (p + n):
        return None
    return Rule(tuple(grown[: best + 1]))


def judge(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """`measured` with `kept`."""
    return measured.withColumn("kept", ~F.col("base_failed") & verdict(rules))
