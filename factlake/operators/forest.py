"""Random forest without a depth limit, kept as tables.

Every tree weighs the rows by a Poisson draw from their key's hash. Nodes above
`small` rows grow level by level: tasks add up histograms of a node's sampled
features over quantile bins, with the smallest and largest value of each bin,
Spark sums them and picks every node's best cut, and the next level starts from
the cuts found so far. All other nodes are finished where their rows meet: the
rows of one node go to one task, which cuts on at exact values until a leaf is
pure or its rows are alike, however deep that is.

The upper cuts are at most trees x rows / small, so they may be broadcast; the
subtrees below are a table, one row each. A prediction walks the upper part,
then joins the subtree it ends in, with hot subtrees in pieces; a forest of few
nodes (counted) is broadcast whole and walked in place.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, factorial, isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.operators.features import FEATURE_NAMES
from factlake.operators.scale import deal, materialize

# Trees and seed.
TREES = 100
SEED = 42
SMALL = 20_000
BINS = 32
BROADCAST_NODES = 1_000_000
ROWS_PER_PIECE = 50_000
ALIKE = -2.0

# Of the Poisson distribution with mean 1.
DRAWS = np.cumsum([exp(-1) / factorial(k) for k in range(12)])
PART = "feature array<int>, threshold array<double>, left array<int>, right array<int>, ones array<double>, gain array<double>"


# ---- rows and nodes ---------------------------------------------------------


def weights(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row, from the hash of its key."""
    h = rows.view(np.uint64) + np.uint64((tree * 2 + 1) * 0x9E3779B97F4A7C15 + seed & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(DRAWS, (h ^ (h >> np.uint64(31))) / 2.0**64, "right")


@dataclass
class Nodes:
    """Nodes of one tree, or of a part of it: a feature (-1: an end) and what
    follows from it; `state` of ends: leaf, part (finished below) or open."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    ones: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    state: list[str] = field(default_factory=lambda: ["open"])
    stubborn: set[int] = field(default_factory=set)

    def add(self, ones: float, state: str) -> int:
        for values, value in zip(
            (self.feature, self.threshold, self.left, self.right, self.ones, self.gain, self.state),
            (-1, 0.0, -1, -1, ones, 0.0, state),
        ):
            values.append(value)
        return len(self.feature) - 1

    def cut(self, node: int, feature: int, threshold: float, gain: float, left: int, right: int) -> None:
        self.feature[node], self.threshold[node], self.gain[node] = feature, threshold, gain
        self.left[node], self.right[node], self.state[node] = left, right, "cut"

    def arrays(self) -> tuple[np.ndarray, ...]:
        kinds = (np.int32, float, np.int32, np.int32, float)
        return tuple(np.array(v, k) for v, k in zip((self.feature, self.threshold, self.left, self.right, self.ones), kinds))


def walk(arrays: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The end that each row comes to; values up to the threshold go left."""
    feature, threshold, left, right, _ = arrays
    node = np.zeros(len(x), np.int32)
    rows = np.arange(len(x))
    while len(rows):
        f = feature[node[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        at = node[rows]
        node[rows] = np.where(x[rows, f] <= threshold[at], left[at], right[at])
    return node


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: list[int], sampled: int) -> Nodes:
    """A whole tree on these rows: at every node the best cut, by Gini, of
    `sampled` random features among those that vary there."""
    rng, out = np.random.default_rng(seed), Nodes()
    one = w * y
    todo = [(np.arange(len(x)), 0)]
    while todo:
        rows, node = todo.pop()
        total, ones = w[rows].sum(), one[rows].sum()
        out.ones[node], out.state[node] = ones / total, "leaf"
        if ones == 0 or ones == total:
            continue
        own = x[rows]
        varying = np.flatnonzero(own.max(0) > own.min(0))
        if not len(varying):
            continue
        picked = rng.permutation(varying)[:sampled]
        own = own[:, picked]
        order = own.argsort(0, kind="stable")
        values = np.take_along_axis(own, order, 0)
        a, b = w[rows][order].cumsum(0)[:-1], one[rows][order].cumsum(0)[:-1]
        gain = _gain(a, b, total, ones)
        gain[values[1:] <= values[:-1]] = -1.0
        place, column = np.unravel_index(gain.argmax(), gain.shape)
        low, high = values[place, column], values[place + 1, column]
        middle = low + (high - low) / 2
        threshold = float(middle if low <= middle < high else low)
        inside = own[:, column] <= threshold
        left, right = out.add(0.0, "open"), out.add(0.0, "open")
        out.cut(node, int(picked[column]), threshold, float(gain[place, column]), left, right)
        todo += [(rows[inside], left), (rows[~inside], right)]
    return out


def _gain(a, b, total, ones):
    """Gini decrease, times weight, of cuts with weight a, b of it ones, left."""

    def pure(n, k):
        return (k * k + (n - k) * (n - k)) / n

    return pure(a, b) + pure(total - a, ones - b) - pure(total, ones)


# ---- fit --------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """tops: tree, node, feature, threshold, left, right, ones, gain of the
    upper nodes; parts: tree, node (where it hangs) and the arrays of a subtree."""

    tops: DataFrame
    parts: DataFrame
    trees: int


def train_forest(
    df: DataFrame, trees: int = TREES, seed: int = SEED, key: str = "doc_id", small: int = SMALL
) -> Forest:
    """Fits (key, features, label). The rows are dealt over all cores, as a
    small file would be read by one task in every pass."""
    rows = df.select(
        F.xxhash64(key).alias("row"),
        vector_to_array("features").alias("x"),
        F.col("label").cast("int").alias("y"),
    )
    rows = materialize(deal(rows, "row"), "forest-rows")
    n, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        raise ValueError("a forest needs rows")
    sampled = max(1, isqrt(width))
    tops = [Nodes() for _ in range(trees)]
    if n > small:
        _grow_levels(rows, tops, width, sampled, seed, small)
    else:
        for top in tops:
            top.state[0] = "part"
    spark = df.sparkSession
    parts = materialize(_finished(rows, tops, sampled, seed), "forest-parts")
    upper = [
        (t, i, top.feature[i], top.threshold[i], top.left[i], top.right[i], top.ones[i], top.gain[i])
        for t, top in enumerate(tops)
        for i in range(len(top.feature))
    ]
    kind = "tree int, node int, feature int, threshold double, left int, right int, ones double, gain double"
    return Forest(materialize(spark.createDataFrame(upper, kind), "forest-tops"), parts, trees)


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    values = np.asarray(batch.column(column).flatten(), float)
    return values.reshape(batch.num_rows, -1) if batch.num_rows else values.reshape(0, 1)


def _grow_levels(rows: DataFrame, tops: list[Nodes], width: int, sampled: int, seed: int, small: int) -> None:
    """Cuts all nodes above `small` rows, a level of all trees at a time."""
    marks = [(i + 0.5) / BINS for i in range(BINS)]
    picks = [F.percentile_approx(F.col("x")[f], marks, 1000).alias(f"q{f}") for f in range(width)]
    cuts = [np.unique(np.array(c, float)) for c in rows.agg(*picks).first()]
    while any("open" in top.state for top in tops):
        sums = _histograms(rows, tops, cuts, sampled, seed)
        found = {(r.tree, r.node): r.best for r in _best_cuts(sums).collect()}
        for t, top in enumerate(tops):
            for node in [i for i, s in enumerate(top.state) if s == "open"]:
                best = found[t, node]
                top.ones[node] = best.ones / best.total
                alike = best.gain == ALIKE  # in the sampled features, or in all
                if best.ones in (0, best.total) or alike and node in top.stubborn:
                    top.state[node] = "leaf"
                    continue
                if alike:
                    top.stubborn.add(node)
                    continue
                sides = []
                for total, ones, count in (
                    (best.a, best.b, best.m),
                    (best.total - best.a, best.ones - best.b, best.rows - best.m),
                ):
                    mixed = 0 < ones < total
                    share = ones / total if total else best.ones / best.total
                    sides.append(top.add(share, "open" if mixed and count > small else "part" if mixed else "leaf"))
                top.cut(node, best.feature, best.threshold, best.gain, *sides)


def _histograms(rows: DataFrame, tops: list[Nodes], cuts: list[np.ndarray], sampled: int, seed: int) -> DataFrame:
    """Weight, ones, rows, and smallest and largest value of every bin of every
    looked-at feature of every open node. A node without a cut so far looks at
    all features."""
    width = len(cuts)
    looked = {}
    for t, top in enumerate(tops):
        for node in [i for i, s in enumerate(top.state) if s == "open"]:
            order = np.random.default_rng([seed, t, node]).permutation(width)
            looked[t, node] = order if node in top.stubborn else order[:sampled]
    shared = rows.sparkSession.sparkContext.broadcast(([top.arrays() for top in tops], looked, cuts, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, looked, cuts, seed = shared.value
        # Nodes of one tree that look at equally many features are added up
        # together: a batch costs the same for few nodes and for many.
        groups = defaultdict(list)
        for t, node in looked:
            groups[t, len(looked[t, node])].append(node)
        size = max(map(len, cuts)) + 1
        by_tree = defaultdict(list)
        for (t, n), nodes in groups.items():
            slot = np.full(len(tops[t][0]), -1)
            slot[nodes] = np.arange(len(nodes))
            sums = np.zeros((n, 5, len(nodes) * size))
            sums[:, 3], sums[:, 4] = np.inf, -np.inf
            by_tree[t].append((np.array(nodes), slot, np.stack([looked[t, node] for node in nodes]), sums))
        for batch in batches:
            x, y = _matrix(batch), batch.column("y").to_numpy()
            hashes = batch.column("row").to_numpy()
            binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], 1)
            for t, parts in by_tree.items():
                w = weights(hashes, t, seed)
                drawn = np.flatnonzero(w)
                ends = walk(tops[t], x[drawn])
                for _, slot, features, sums in parts:
                    at = slot[ends]
                    own, at = drawn[at >= 0], at[at >= 0]
                    weight, one = w[own], w[own] * y[own]
                    for f, total in zip(features.T, sums):
                        feature = f[at]
                        bins, values = at * size + binned[own, feature], x[own, feature]
                        for k, added in enumerate((weight, one, None)):
                            total[k] += np.bincount(bins, added, total.shape[1])
                        np.minimum.at(total[3], bins, values)
                        np.maximum.at(total[4], bins, values)
        for t, parts in by_tree.items():
            for nodes, _, features, sums in parts:
                for f, total in zip(features.T, sums):
                    bins = np.flatnonzero(total[2])
                    of = bins // size
                    same = (np.full(len(bins), t), nodes[of], f[of], bins % size)
                    columns = [*(pa.array(c.astype(np.int32)) for c in same), *(pa.array(c[bins]) for c in total)]
                    yield pa.RecordBatch.from_arrays(columns, names=["tree", "node", "feature", "bin", "w", "one", "m", "low", "high"])

    kind = "tree int, node int, feature int, bin int, w double, one double, m double, low double, high double"
    added = [F.sum(c).alias(c) for c in ("w", "one", "m")]
    return rows.mapInArrow(run, kind).groupBy("tree", "node", "feature", "bin").agg(
        *added, F.min("low").alias("low"), F.max("high").alias("high")
    )


def _best_cuts(sums: DataFrame) -> DataFrame:
    """tree, node, best: the cut between two bins with the largest gain; where
    the values of a node share one bin, the middle of that bin; where they are
    all alike, no cut (its gain is `ALIKE`)."""
    feature = Window.partitionBy("tree", "node", "feature")
    upto = feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = sums.select(
        "*",
        *[F.sum(c).over(upto).alias(n) for c, n in (("w", "a"), ("one", "b"), ("m", "left"))],
        *[F.sum(c).over(feature).alias(n) for c, n in (("w", "total"), ("one", "ones"), ("m", "rows"))],
        F.lead("low").over(feature.orderBy("bin")).alias("next"),
        F.count("*").over(feature).alias("filled"),
    )
    gain = (
        "(b * b + (a - b) * (a - b)) / a"
        " + ((ones - b) * (ones - b) + (total - a - ones + b) * (total - a - ones + b)) / (total - a)"
        " - (ones * ones + (total - ones) * (total - ones)) / total"
    )
    between = bins.filter("next IS NOT NULL").selectExpr(
        "tree", "node", f"{gain} AS gain", "feature", "high + (next - high) / 2 AS threshold", "a", "b",
        "total", "ones", "left AS m", "rows",
    )
    # the halves of one bin are unknown: both are looked at again
    inside = bins.filter("filled = 1").selectExpr(
        "tree", "node", f"CAST(IF(low < high, -1, {ALIKE}) AS DOUBLE) AS gain", "feature", "low + (high - low) / 2 AS threshold", "total / 2 AS a", "ones / 2 AS b",
        "total", "ones", "rows AS m", "2 * rows AS rows",
    )
    both = between.unionByName(inside)
    names = ["gain", "feature", "threshold", "a", "b", "total", "ones", "m", "rows"]
    return both.groupBy("tree", "node").agg(F.max(F.struct(*names)).alias("best"))


def _finished(rows: DataFrame, tops: list[Nodes], sampled: int, seed: int) -> DataFrame:
    """tree, node and the arrays of the subtree of every node that is a part."""
    states = [np.array([s == "part" for s in top.state]) for top in tops]
    shared = rows.sparkSession.sparkContext.broadcast(([top.arrays() for top in tops], states, seed))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, states, seed = shared.value
        for batch in batches:
            x, hashes = _matrix(batch), batch.column("row").to_numpy()
            for t, top in enumerate(tops):
                w = weights(hashes, t, seed)
                drawn = np.flatnonzero(w)
                ends = walk(top, x[drawn])
                keep = states[t][ends]
                drawn, ends = drawn[keep], ends[keep]
                own = batch.take(pa.array(drawn))
                columns = [np.full(len(drawn), t, np.int32), ends, w[drawn].astype(np.int32)]
                arrays = [pa.array(c) for c in columns] + [own.column(c) for c in ("row", "x", "y")]
                yield pa.RecordBatch.from_arrays(arrays, names=["tree", "node", "w", "row", "x", "y"])

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        tree, node = (int(k.as_py()) for k in key)
        table = table.combine_chunks()
        x = np.asarray(table["x"].combine_chunks().flatten(), float).reshape(table.num_rows, -1)
        y, w, row = (table[c].to_numpy() for c in ("y", "w", "row"))
        order = np.lexsort((*x.T[::-1], y, row))
        nodes = grow(x[order], y[order].astype(float), w[order].astype(float), [seed, tree, node], sampled)
        arrays = [nodes.feature, nodes.threshold, nodes.left, nodes.right, nodes.ones, nodes.gain]
        kinds = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        lists = [pa.array([a], pa.list_(k)) for a, k in zip(arrays, kinds)]
        names = ["tree", "node", "feature", "threshold", "left", "right", "ones", "gain"]
        return pa.table([pa.array([tree], pa.int32()), pa.array([node], pa.int32()), *lists], names=names)

    kind = "tree int, node int, w int, row bigint, x array<double>, y int"
    met = rows.mapInArrow(dealt, kind).groupBy("tree", "node")
    return met.applyInArrow(finish, f"tree int, node int, {PART}")


# ---- use --------------------------------------------------------------------


def _upper(model: Forest) -> list[tuple[np.ndarray, ...]]:
    found: dict[int, Nodes] = {t: Nodes([], [], [], [], [], [], []) for t in range(model.trees)}
    for r in model.tops.orderBy("tree", "node").toLocalIterator():
        top = found[r.tree]
        for name in ("feature", "threshold", "left", "right", "ones", "gain"):
            getattr(top, name).append(r[name])
    return [found[t].arrays() for t in range(model.trees)]


def predict(model: Forest, df: DataFrame, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """`df` with y_pred instead of features: the class whose mean share in the
    ends of all trees is larger, 0 where both are equal. `df` is walked where
    its rows are."""
    nodes = model.parts.agg(F.sum(F.size("feature"))).first()[0] or 0
    if nodes <= broadcast_nodes:
        return _predict_here(model, df)
    return _predict_joined(model, df)


def _predict_here(model: Forest, df: DataFrame) -> DataFrame:
    parts = {
        (r.tree, r.node): tuple(np.array(r[c]) for c in ("feature", "threshold", "left", "right", "ones"))
        for r in model.parts.toLocalIterator()
    }
    shared = df.sparkSession.sparkContext.broadcast((_upper(model), parts))

    @F.arrow_udf("double")
    def share(x: pa.Array) -> pa.Array:
        tops, parts = shared.value
        rows = np.asarray(x.flatten(), float).reshape(len(x), -1) if len(x) else np.zeros((0, 1))
        total = np.zeros(len(x))
        for t, top in enumerate(tops):
            ends = walk(top, rows)
            own = top[4][ends]
            for node in np.unique(ends):
                if (t, node) in parts:
                    part, at = parts[t, node], np.flatnonzero(ends == node)
                    own[at] = part[4][walk(part, rows[at])]
            total += own
        return pa.array(total / len(tops))

    return df.withColumn("y_pred", (share(vector_to_array("features")) > 0.5).cast("int")).drop("features")


def _predict_joined(model: Forest, df: DataFrame, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(_upper(model))
    carried = materialize(
        df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_x", vector_to_array("features")), "asked"
    )

    @F.arrow_udf("array<struct<tree:int,node:int,ones:double>>")
    def ends(x: pa.Array) -> pa.Array:
        tops = shared.value
        rows = np.asarray(x.flatten(), float).reshape(len(x), -1) if len(x) else np.zeros((0, 1))
        node = np.stack([walk(top, rows) for top in tops], 1)
        ones = np.stack([top[4][node[:, t]] for t, top in enumerate(tops)], 1)
        tree = np.tile(np.arange(len(tops), dtype=np.int32), len(x))
        columns = [pa.array(tree), pa.array(node.ravel().astype(np.int32)), pa.array(ones.ravel())]
        at = np.arange(len(x) + 1, dtype=np.int32) * len(tops)
        return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(columns, names=["tree", "node", "ones"]))

    pieces = max(1, -(-carried.count() // rows_per_piece))
    reached = carried.select("_row", "_x", F.explode(ends("_x")).alias("_e")).select("_row", "_x", "_e.*")
    reached = reached.withColumn("piece", F.pmod(F.xxhash64("_row"), F.lit(pieces)).cast("int"))
    below = model.parts.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))

    def finish(rows: pa.Table, part: pa.Table) -> pa.Table:
        own = rows["q"].combine_chunks()
        if not len(own):
            return pa.table({"_row": pa.array([], pa.int64()), "_share": pa.array([], pa.float64())})
        share = np.asarray(own.field("ones"))
        if len(part):
            arrays = tuple(np.array(part[c][0].as_py()) for c in ("feature", "threshold", "left", "right", "ones"))
            x = np.asarray(own.field("_x").flatten(), float).reshape(len(own), -1)
            share = arrays[4][walk(arrays, x)]
        return pa.table({"_row": own.field("_row"), "_share": pa.array(share, pa.float64())})

    keys = ["tree", "node", "piece"]
    asked = reached.select(*keys, F.struct("_row", "_x", "ones").alias("q")).groupBy(*keys)
    shares = asked.cogroup(below.groupBy(*keys)).applyInArrow(finish, "_row bigint, _share double")
    mean = shares.groupBy("_row").agg((F.avg("_share") > 0.5).cast("int").alias("y_pred"))
    return carried.drop("_x").join(mean, "_row").drop("_row", "features")


def tree_depths(model: Forest) -> DataFrame:
    """tree, depth: the longest way from the root to an end."""

    def deepest(left: list[int], right: list[int], ends: dict[int, int]) -> int:
        depth, todo = 0, [(0, 0)]
        while todo:
            node, d = todo.pop()
            depth = max(depth, d + ends.get(node, 0))
            todo += [(c, d + 1) for c in (left[node], right[node]) if c >= 0]
        return depth

    def run(key: tuple, tops: pa.Table, parts: pa.Table) -> pa.Table:
        below = {r["node"]: deepest(r["left"], r["right"], {}) for r in parts.to_pylist()}
        rows = sorted(tops.to_pylist(), key=lambda r: r["node"])
        depth = deepest([r["left"] for r in rows], [r["right"] for r in rows], below)
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "depth": pa.array([depth], pa.int32())})

    both = model.tops.groupBy("tree").cogroup(model.parts.groupBy("tree"))
    return both.applyInArrow(run, "tree int, depth int")


def feature_importances(model: Forest, like: DataFrame) -> DataFrame:
    """feature, importance: the mean over trees of a feature's share in all
    Gini decreases; they add up to 1."""
    upper = model.tops.select("tree", "feature", "gain")
    lower = model.parts.select("tree", F.inline(F.arrays_zip("feature", "gain")))
    cuts = upper.unionByName(lower).filter("feature >= 0 AND gain > 0")
    own = cuts.groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
    whole = own.groupBy("tree").agg(F.sum("gain").alias("all"))
    shares = own.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("all")).alias("share"))
    names = like.sparkSession.createDataFrame(list(enumerate(FEATURE_NAMES)), "feature int, name string")
    total = shares.agg(F.sum("share")).first()[0] or 1.0
    return names.join(shares, "feature", "left").select(
        F.col("name").alias("feature"), (F.coalesce("share", F.lit(0.0)) / total).alias("importance")
    )
