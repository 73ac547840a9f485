"""A Merkle manifest: every row is a leaf of its group's tree, every group's
root a leaf of the tree above, and every row gets its inclusion proof.

Trees grow level by level. At each level every node finds the other nodes of
its run by an equijoin with their computed index: index XOR 1 for binary trees,
the run's slots one after the other for wider ones. The rows in slot zero then
emit the parents. Proofs come down the same levels: a node's path is its own
siblings and its parent's path. All trees grow at the same time, each level is
a table in the shared folder, and no text is shuffled: leaves are hashed where
rows are read. Levels that are small by count are joined by broadcast.

Digests are sha256, held as 32 bytes and hashed as lowercase hex text. In a
leaf null is `-`, any other value its number of UTF-8 bytes, `:` and its text.
Leaves ascend by key (null first), ties by digest, so equal rows share a digest
but have places and proofs of their own; empty texts are `0:`. A null group is
a tree of its own, before all others. A tree of one leaf has this leaf as its
root; an empty table has no rows. Other columns are left out unless they are
named in `keep`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.operators.scale import dense_index, has_at_most, lookup_join, materialize

# Nodes of about 150 bytes. All levels from the first of this size on hold at
# most twice as many, and a few for every group.
BROADCAST_NODES = 50_000


def _digest(parts: Column) -> Column:
    return F.unhex(F.sha2(F.lower(F.hex(parts)), 256))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields, in their order."""
    texts = [f.cast("string") for f in fields]
    coded = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*coded), 256))


def manifest(
    df: DataFrame,
    key: str,
    group: str,
    fields: Sequence[str],
    arity: int = 2,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of `df`: the columns of `keep` (by default key), leaf,
    subroot and root (hex text) and path: from the leaf to the root, what stands
    left and right of the node in its run (digests one after the other)."""
    keep = keep or {key: F.col(key)}
    leaves = materialize(
        df.select(
            F.struct(*[c.alias(n) for n, c in keep.items()]).alias("row"),
            F.col(key).alias("key"),
            F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("tree"),
            leaf([F.col(f) for f in fields]).alias("digest"),
        ),
        "leaves",
    )
    placed = dense_index(leaves, [F.asc("tree"), F.asc_nulls_first("key"), F.asc("digest")], "at")
    trees = materialize(placed.groupBy("tree").agg(F.min("at").alias("start"), F.count("*").alias("n")), "trees")
    nodes = lookup_join(placed, trees, "tree", "at").select(
        "tree", "n", (F.col("at") - F.col("start")).alias("idx"), "digest", "row"
    )
    levels = grow(nodes, trees, arity)

    roots = levels[0].filter("n = 1").select("tree", "digest")
    for level in levels[1:]:
        roots = roots.unionByName(level.filter("n = 1").select("tree", "digest"))
    size = F.lit(trees.count())
    above = dense_index(roots, [F.asc("tree")], "idx").select(
        F.lit("").alias("tree"), size.alias("n"), "idx", "digest", F.struct("tree").alias("row")
    )
    tops = grow(above, above.select("tree", "n").limit(1), arity)
    root = tops[-1].filter("n = 1").select("digest").first()
    ends = proofs(tops, None, arity).selectExpr("row.tree AS tree", "digest AS subroot", "path AS rest")
    ends = materialize(ends, "roots")
    rows = proofs(levels, ends.drop("subroot"), arity)
    rows = lookup_join(rows, ends.drop("rest"), "tree", "idx")
    return rows.select(
        "row.*",
        _text(F.col("digest")).alias("leaf"),
        _text(F.col("subroot")).alias("subroot"),
        F.lit(bytes(root[0]).hex() if root else None).cast("string").alias("root"),
        "path",
    )


def grow(nodes: DataFrame, trees: DataFrame, arity: int) -> list[DataFrame]:
    """Tables of all levels. `nodes` has tree, n (its nodes), idx, digest and
    perhaps row; a level has beside these left and right. `trees` has tree, n."""
    if arity < 2:
        raise ValueError("a run has at least two nodes")
    biggest, total, count = trees.agg(F.max("n"), F.sum("n"), F.count("*")).first()
    levels = []
    while True:
        small = (total or 0) <= BROADCAST_NODES
        levels.append(materialize(_with_siblings(nodes, arity, small), "level"))
        if (biggest or 1) <= 1:
            return levels
        nodes = levels[-1].filter(f"n > 1 AND idx % {arity} = 0").selectExpr(
            "tree",
            f"(n + {arity - 1}) div {arity} AS n",
            f"idx div {arity} AS idx",
            "unhex(sha2(lower(hex(concat(digest, right))), 256)) AS digest",
        )
        biggest = -(-biggest // arity)
        total = total // arity + count


def _with_siblings(nodes: DataFrame, arity: int, small: bool) -> DataFrame:
    """Adds left and right: the digests of the run's nodes before and after."""
    found = nodes
    for shift in range(1, arity):
        sought = "idx ^ 1" if arity == 2 else f"idx - idx % {arity} + (idx + {shift}) % {arity}"
        others = nodes.selectExpr("tree AS _tree", "idx AS _idx", f"digest AS _s{shift}")
        found = found.join(
            F.broadcast(others) if small else others, F.expr(f"tree = _tree AND {sought} = _idx"), "left"
        ).drop("_tree", "_idx")
    shifts = ", ".join(f"_s{shift}" for shift in range(1, arity))

    def side(order: str) -> str:
        slots = [
            f"CASE WHEN idx % {arity} {order} {s} THEN"
            f" coalesce(get(array({shifts}), CAST(pmod({s} - idx % {arity}, {arity}) - 1 AS INT)), X'') ELSE X'' END"
            for s in range(arity)
        ]
        return f"concat({', '.join(slots)})"

    return found.selectExpr(*nodes.columns, f"{side('>')} AS left", f"{side('<')} AS right")


def proofs(levels: Sequence[DataFrame], ends: DataFrame | None, arity: int) -> DataFrame:
    """The lowest level with path. `ends` has tree and rest, the path of its
    root; without it that path is empty."""
    entry = "CASE WHEN n > 1 THEN struct(left, right) END AS _e0"
    low = next((i for i, x in enumerate(levels) if has_at_most(x, BROADCAST_NODES)), len(levels) - 1)
    low = max(0, low - 1)
    found = levels[low].selectExpr("*", entry)
    for up, level in enumerate(levels[low + 1 :], 1):
        nodes = level.filter("n > 1").selectExpr("tree AS _tree", "idx AS _idx", f"struct(left, right) AS _e{up}")
        same = F.expr(f"tree = _tree AND idx div {arity**up} = _idx")
        found = found.join(F.broadcast(nodes), same, "left").drop("_tree", "_idx")
    entries = ", ".join(f"_e{up}" for up in range(len(levels) - low))
    path = f"array_compact(array({entries}))"
    while True:
        if ends is not None:
            # the rest of the trees that end here; those that go on have it from above
            last = ends.selectExpr("tree AS _tree", "rest AS _rest")
            same = F.expr("tree = _tree AND n = 1" if "_above" in found.columns else "tree = _tree")
            found = found.join(last, same, "left").drop("_tree")
            path = f"concat({path}, coalesce(_rest, array()))"
        found = found.selectExpr(*levels[low].columns, f"{path} AS path")
        if low == 0:
            return found
        low -= 1
        above = materialize(found.select("tree", "idx", "path"), "paths")
        above = above.selectExpr("tree AS _tree", "idx AS _up", "path AS _above")
        same = F.expr(f"tree = _tree AND idx div {arity} = _up AND n > 1")
        found = levels[low].selectExpr("*", entry).join(above, same, "left").drop("_tree", "_up")
        path = "concat(array_compact(array(_e0)), coalesce(_above, array()))"


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, from leaf to root, left to right."""
    pairs = F.transform(path, lambda e: _text(F.concat(e["left"], e["right"])))
    return F.sha2(F.array_join(pairs, ""), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root (hex text) that follows from a leaf (hex text) and a path."""
    return _text(
        F.aggregate(path, F.unhex(digest), lambda own, e: _digest(F.concat(e["left"], own, e["right"])))
    )


def manifest_sql(fields: Sequence[str], tampered: Sequence[str], chosen: str) -> str:
    """Binary trees of documents by lang in SQL: `fields` and `tampered` are the
    expressions of a leaf's fields, `chosen` which rows are tampered with."""

    def hashed(parts: Sequence[str]) -> str:
        coded = [f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in (f"CAST({p} AS VARCHAR)" for p in parts)]
        return f"sha256({' || '.join(coded)})"

    def tree(name: str, source: str, kind: str) -> str:
        return f"""
    {name}(kind, level, tree, n, idx, digest) AS (
      SELECT {kind}, 0, tree, n, idx, leaf FROM {source}
      UNION ALL
      SELECT kind, level + 1, tree, (n + 1) // 2, idx // 2, sha256(string_agg(digest, '' ORDER BY idx))
      FROM {name} WHERE n > 1 GROUP BY kind, level, tree, n, idx // 2)"""

    def steps(name: str, source: str, nodes: str) -> str:
        return f"""
    {name} AS (
      SELECT o.kind, p.tree, p.idx, o.level,
        CASE WHEN (p.idx >> o.level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.digest, '') AS step
      FROM {source} p JOIN {nodes} o ON o.tree = p.tree AND o.idx = p.idx >> o.level AND o.n > 1
      LEFT JOIN {nodes} s ON s.tree = o.tree AND s.level = o.level AND s.idx = xor(o.idx, 1))"""

    return f"""
    WITH RECURSIVE leaves AS (
      SELECT doc_id, coalesce('+' || lang, '') AS tree, {hashed(fields)} AS leaf,
        CASE WHEN {chosen} THEN {hashed(tampered)} ELSE {hashed(fields)} END AS shown
      FROM documents),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
        count(*) OVER (PARTITION BY tree) AS n
      FROM leaves),{tree('nodes', 'placed', '0')},
    subroots AS (SELECT tree AS lang_tree, digest AS leaf FROM nodes WHERE n = 1),
    tops AS (
      SELECT '' AS tree, lang_tree, leaf, row_number() OVER (ORDER BY lang_tree) - 1 AS idx,
        count(*) OVER () AS n
      FROM subroots),{tree('above', 'tops', '1')},{steps('inner_steps', 'placed', 'nodes')},{steps('outer_steps', 'tops', 'above')},
    all_steps AS (
      SELECT tree, idx, 0 AS kind, level, step FROM inner_steps
      UNION ALL
      SELECT p.tree, p.idx, 1, o.level, o.step FROM placed p JOIN tops t ON t.lang_tree = p.tree
      JOIN outer_steps o ON o.idx = t.idx),
    paths AS (
      SELECT tree, idx, list(step ORDER BY kind, level) AS steps,
        sha256(string_agg(step[2:], '' ORDER BY kind, level)) AS proof_sha256
      FROM all_steps GROUP BY tree, idx)
    SELECT doc_id, p.leaf, s.leaf AS subroot, r.digest AS root,
      coalesce(proof_sha256, sha256('')) AS proof_sha256,
      list_reduce([shown] || coalesce(steps, []), lambda own, step:
        sha256(CASE WHEN step[1] = 'L' THEN step[2:] || own ELSE own || step[2:] END)) AS folded_root,
      folded_root = r.digest AS verified
    FROM placed p JOIN subroots s ON s.lang_tree = p.tree
    JOIN (SELECT digest FROM above WHERE n = 1) r ON true
    LEFT JOIN paths USING (tree, idx)"""
