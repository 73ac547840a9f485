"""Merkle manifests against trees built one node after the other."""

import random
from collections import defaultdict
from hashlib import sha256

import pytest

from factlake.llm import merkle
from factlake.llm.merkle import folded, manifest, proof_digest
from factlake.llm.queries import op11_merkle_manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, path string, tree string, idx int"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row):
    parts = [None if row[f] is None else str(row[f]) for f in FIELDS]
    return h("".join("-" if p is None else f"{len(p.encode())}:{p}" for p in parts))


def climb(leaves, arity):
    """The root, and of every leaf its siblings: (before, after) a level."""
    paths = [[] for _ in leaves]
    own = [[i] for i in range(len(leaves))]
    nodes = list(leaves)
    while len(nodes) > 1:
        up, above = [], []
        for a in range(0, len(nodes), arity):
            run = nodes[a : a + arity]
            for k in range(len(run)):
                for i in own[a + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h("".join(run)))
            above.append([i for k in range(len(run)) for i in own[a + k]])
        nodes, own = up, above
    return nodes[0], paths


def slow(rows, arity):
    """(doc_id, leaf) to all (subroot, root, path), as lists: rows may repeat."""
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row)))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [climb([leaf for *_, leaf in sorted(groups[n])], arity) for n in names]
    root, tops = climb([t[0] for t in trees], arity)
    out = defaultdict(list)
    for name, (sub, paths), top in zip(names, trees, tops):
        for (known, doc, leaf), path in zip(sorted(groups[name]), paths):
            out[(doc if known else None, leaf)].append((sub, root, tuple(path + top)))
    return {k: sorted(v) for k, v in out.items()}


def got(out):
    found = defaultdict(list)
    rows = out.select("*", proof_digest(out["path"]).alias("proof"), folded(out["leaf"], out["path"]).alias("up"))
    for r in rows.collect():
        path = tuple((bytes(e["left"]).hex(), bytes(e["right"]).hex()) for e in r.path)
        found[(r.doc_id, r.leaf)].append((r.subroot, r.root, path))
        assert r.proof == h("".join(a + b for a, b in path))
        assert r.up == r.root
    return {k: sorted(v) for k, v in found.items()}


def sample(n, seed=1):
    rng = random.Random(seed)
    langs = [None, "", "-", "de", "en", "en", "en", "zzé", "😀"]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "x", "größer 😀", "line\nline", "w " * 500])
        rows.append((i * 3 - 50, rng.choice([None, "", "src"]), rng.choice(langs), rng.choice([None, 0, 9]), text, "p", "t", 5))
    return rows


@pytest.mark.parametrize("arity, n", [(2, 150), (3, 101), (2, 1)])
def test_equals_one_by_one(spark, arity, n):
    rows = sample(n)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = slow([dict(zip(FIELDS, r)) for r in rows], arity)
    assert got(manifest(frame, "doc_id", "lang", FIELDS, arity)) == expected


def test_shuffled_levels(spark, monkeypatch):
    """Levels above the broadcast size give the same proofs."""
    monkeypatch.setattr(merkle, "BROADCAST_NODES", 6)
    rows = sample(90, 2)
    frame = spark.createDataFrame(rows, SCHEMA)
    for arity in (2, 3):
        expected = slow([dict(zip(FIELDS, r)) for r in rows], arity)
        assert got(manifest(frame, "doc_id", "lang", FIELDS, arity)) == expected


def test_repeated_rows_null_ids_one_group_and_no_rows(spark):
    rows = [(1, "s", "en", 3, "abc", "", "", 0)] * 5 + [(None, "s", "en", 3, t, "", "", 0) for t in "aab"]
    rows += [(1, "s", "en", 3, "other", "", "", 0)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = manifest(frame, "doc_id", "lang", FIELDS)
    assert got(out) == slow([dict(zip(FIELDS, r)) for r in rows], 2)
    assert manifest(frame.limit(0), "doc_id", "lang", FIELDS).collect() == []
    with pytest.raises(ValueError):
        manifest(frame, "doc_id", "lang", FIELDS, arity=1)


def test_only_tampered_rows_fail(spark, sf):
    from zlib import crc32

    rows = op11_merkle_manifest(spark, sf).collect()
    chars = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(chars)
    for r in rows:
        hit = crc32(str(r.doc_id).encode()) % 7 == 0 and chars[r.doc_id] is not None
        assert r.verified != hit and (r.folded_root == r.root) == r.verified
    assert len({r.root for r in rows}) == 1
