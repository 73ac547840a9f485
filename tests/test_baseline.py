"""The linguistic baseline: shapes, invariants, and parts against numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from factlake.operators import features as ft
from factlake.operators import scale, scoring
from factlake.operators.forest import (
    Nodes, _predict_joined, feature_importances, grow, predict, train_forest, tree_depths, walk, weights,
)
from factlake.operators.pca import fit_pca
from factlake.operators.scoring import embed_mean
from factlake.plans import baseline
from factlake.plans.compare import compare_systems

FAKE = "fear lies anger hoax shock panic rumor secret".split()
REAL = "report court vote budget senate trade policy trust".split()
COMMON = "the of and city people said year day".split()
RARE = [f"{a}{b}" for a in ("north", "south", "east", "west") for b in ("ern", "land", "side", "ward", "port")]
DIM = 24


def articles(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = int(i % 2)
        pool = (REAL if label else FAKE) + COMMON + RARE
        text = " ".join(rng.choice(pool, size=60))
        rows.append((seed * 100_000 + i, f"Title {i}!", f"{text} http://x.y/{i}", label))
    return rows


@pytest.fixture(scope="module")
def run(spark):
    schema = "doc_id long, title string, text string, label int"
    train = spark.createDataFrame(articles(160, 1), schema)
    test = spark.createDataFrame(articles(60, 2), schema)
    rng = np.random.default_rng(5)
    words = FAKE + REAL + COMMON[:4]
    vectors = spark.createDataFrame(
        [(w, rng.standard_normal(DIM).tolist()) for w in words], "word string, vector array<double>"
    )
    affects = [("fear", "fear"), ("fear", "negative"), ("anger", "anger"), ("trust", "trust"),
               ("trust", "positive"), ("panic", "fear"), ("shock", "surprise"), ("the", "positive")]
    lexicon = spark.createDataFrame(affects, "word string, affect string")
    return baseline.run_baseline(train, test, vectors, DIM, lexicon), train, test


def test_cleaning(run):
    for df in run[1:]:
        for r in baseline.cleaned(df).collect():
            text = r["content"]
            assert text and text == text.strip() and "http" not in text
            assert set(text) <= set("abcdefghijklmnopqrstuvwxyz ")


def test_features(run):
    result, train, test = run
    for df, n in ((train, 160), (test, 60)):
        out = result.features.transform(baseline.cleaned(df))
        rows = out.select(vector_to_array("features").alias("f")).collect()
        assert len(rows) == n
        matrix = np.array([r["f"] for r in rows])
        assert matrix.shape == (n, 48) and not np.isnan(matrix).any()
        assert ((matrix[:, 40:] >= 0) & (matrix[:, 40:] <= 1)).all()


def test_quality_and_importances(run):
    result = run[0]
    row = result.metrics.first()
    assert row["n_scored"] == 60 and result.latency_mean_sec > 0
    for metric in ("accuracy", "precision", "recall", "f1"):
        assert row[metric] > 0.75
    found = feature_importances(result.forest, result.predictions).collect()
    assert [r["feature"] for r in found] == ft.FEATURE_NAMES and len(found) == 48
    assert abs(sum(r["importance"] for r in found) - 1) < 1e-6


def test_comparison(run, spark):
    result = run[0]
    verified = spark.createDataFrame(
        [(1, "fake", True, 2.0), (2, "real", True, 4.0), (3, None, False, None)],
        "query_id long, verdict string, is_valid boolean, latency_sec double",
    )
    truth = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "query_id long, label int")
    table = compare_systems(result.predictions, result.latency_mean_sec, truth, verified)
    rows = {r["system"]: r for r in table.collect()}
    assert len(rows) == 3
    assert (rows["RAG"]["accuracy"], rows["RAG"]["recall"], rows["RAG"]["latency_mean_sec"]) == (0.5, 0.5, 3.0)
    assert rows["NC-LBFV"]["accuracy"] == round(result.metrics.first()["accuracy"], 4)


def test_emotions_count_all_affects(spark):
    docs = spark.createDataFrame([(1, "fear trust fear none"), (2, "none"), (3, "")], "doc_id long, content string")
    lexicon = spark.createDataFrame(
        [("fear", "fear"), ("fear", "negative"), ("trust", "trust")], "word string, affect string"
    )
    got = {r["doc_id"]: r for r in ft.emotion_scores(docs, lexicon).collect()}
    assert (got[1]["fear"], got[1]["trust"], got[1]["joy"]) == (0.4, 0.2, 0.0)
    assert all(got[i][e] == 0.0 for i in (2, 3) for e in ft.EMOTIONS)


@pytest.mark.parametrize("limit", [10**9, 8])
def test_mean_vectors_count_unknown_words_as_zeros(spark, monkeypatch, limit):
    monkeypatch.setattr(scoring, "MAX_MATRIX_BYTES", limit)
    docs = spark.createDataFrame([(1, ["a", "b", "a", "x"]), (2, ["x"]), (3, [])], "doc_id long, words array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.0, 4.0])], "word string, vector array<double>")
    got = {r["doc_id"]: r["vector"] for r in embed_mean(docs, vectors, 2).collect()}
    assert got == {1: [0.5, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_tfidf_by_hand(spark, monkeypatch):
    texts = ["aa bb bb", "aa cc", "aa bb dd", "aa ee ee ee", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    model = ft.fit_tfidf(docs)
    # aa is in 80 % of the documents; cc, dd, ee are in one each.
    assert model.terms == ["aa", "bb"]
    assert model.idf == pytest.approx([np.log(6 / 5) + 1, np.log(6 / 3) + 1])
    rows = model.transform(docs).select("doc_id", vector_to_array("tfidf").alias("v")).collect()
    got = np.array([r["v"] for r in sorted(rows, key=lambda r: r["doc_id"])])
    raw = np.array([[1, 2], [1, 0], [1, 1], [1, 0], [0, 0]]) * np.array(model.idf)
    length = np.linalg.norm(raw, axis=1, keepdims=True)
    assert got == pytest.approx(raw / np.where(length, length, 1))
    long = ft.tfidf_long(docs, ft.top_terms(ft.vocabulary(docs)))
    for r in long.collect():
        assert r["weight"] == pytest.approx(got[r["doc_id"], model.terms.index(r["term"])])
    monkeypatch.setattr(ft, "MAX_TERMS", 1)  # more terms than a row may hold
    joined = ft.tfidf_long(docs, ft.vocabulary(docs)).collect()
    shown = lambda rows: {(r.doc_id, r.term): round(r.weight, 12) for r in rows}
    assert shown(joined) == shown(long.collect()) and len(joined) == 6
    assert ft.tfidf_long(docs, ft.vocabulary(docs).limit(0)).collect() == []
    assert ft.fit_tfidf(docs, max_df=0.7).terms == ["bb"]
    assert ft.fit_tfidf(docs, max_terms=1).terms == ["aa"]


@pytest.mark.parametrize("sparse", [True, False])
def test_components_against_dense_decomposition(spark, sparse):
    rng = np.random.default_rng(3)
    matrix = rng.standard_normal((150, 8)) @ rng.standard_normal((8, 40)) + 0.1 * rng.standard_normal((150, 40)) + 3
    matrix[rng.random(matrix.shape) < 0.5] = 0
    rows = [
        (i, Vectors.sparse(40, np.flatnonzero(r).tolist(), r[r != 0].tolist()) if sparse else Vectors.dense(r))
        for i, r in enumerate(matrix)
    ]
    df = spark.createDataFrame(rows, ["doc_id", "v"]).repartition(5)
    model = fit_pca(df, "v", 6)
    centred = matrix - matrix.mean(axis=0)
    exact = np.linalg.svd(centred, compute_uv=False)[:6] ** 2 / 149
    assert model.variances == pytest.approx(exact, rel=0.02)
    assert model.components.T @ model.components == pytest.approx(np.eye(6), abs=1e-9)
    top = model.components[np.abs(model.components).argmax(axis=0), range(6)]
    assert (top > 0).all()
    out = model.transform(df, "v", "p").select("doc_id", "p").collect()
    got = np.array([r["p"] for r in sorted(out, key=lambda r: r["doc_id"])])
    assert got == pytest.approx(centred @ model.components)


def test_hot_word_is_split(spark, monkeypatch):
    """A third of all tokens is one word and the vectors may not be broadcast."""
    monkeypatch.setattr(scoring, "has_at_most", lambda df, rows: False)
    monkeypatch.setattr(scale, "has_at_most", lambda df, rows: False)
    monkeypatch.setattr(scale, "ROWS_PER_SPLIT", 50)
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"),
        F.array(F.lit("hot"), F.concat(F.lit("w"), F.col("id") % 50), F.lit("none")).alias("words"),
    )
    vectors = spark.range(50).select(
        F.concat(F.lit("w"), "id").alias("word"), F.array(F.col("id").cast("double")).alias("vector")
    ).unionByName(spark.createDataFrame([("hot", [3.0])], "word string, vector array<double>"))
    got = {r["doc_id"]: r["vector"][0] for r in embed_mean(docs, vectors, 1).collect()}
    assert got == {i: pytest.approx((3.0 + i % 50) / 3) for i in range(300)}


@pytest.mark.parametrize("common", [0, 2, 100])
def test_mean_vectors_of_common_and_other_words(spark, common):
    """Ids may repeat or be missing, and few rows of the exploded words are
    joined once the common words are summed up in place."""
    lists = [(1, ["a", "b", "a", "x", None]), (1, ["c"]), (None, ["a", "d"]), (3, []), (4, None), (5, ["b", "c", "c"])]
    docs = spark.createDataFrame(lists, "doc_id long, words array<string>").repartition(3)
    given = {"a": [1.0, 2.0], "b": [0.0, 4.0], "c": [3.0, 0.0], "d": [0.5, 0.5]}
    vectors = spark.createDataFrame(list(given.items()), "word string, vector array<double>")
    expected = []
    for doc, words in lists:
        rows = [given.get(w, [0.0, 0.0]) for w in words or []]
        expected.append((doc or 0, [round(sum(r[j] for r in rows) / max(len(rows), 1), 9) for j in (0, 1)]))
    found = embed_mean(docs, vectors, 2, max_bytes=0, common=common)
    assert sorted((r.doc_id or 0, [round(x, 9) for x in r.vector]) for r in found.collect()) == sorted(expected)


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_mean_vectors_with_gaps(spark, max_bytes):
    from factlake.operators.scoring import embed_mean

    given = [("a", None), ("b", [1.0, 2.0]), ("c", [5.0, 0.0]), ("c", [7.0, 0.0]), (None, [9.0, 9.0]), ("d", [None, 1.0])]
    vectors = spark.createDataFrame(given, "word string, vector array<double>")
    docs = spark.createDataFrame([(1, ["b"]), (2, ["a", "b", "c", "c"]), (3, []), (4, ["d", None])], "doc_id long, words array<string>")
    got = {r.doc_id: list(r.vector) for r in embed_mean(docs, vectors, 2, max_bytes=max_bytes).collect()}
    assert got == {1: [1.0, 2.0], 2: [11 / 4, 0.5], 3: [0.0, 0.0], 4: [0.0, 0.5]}
    with pytest.raises(Exception, match="2 numbers"):
        embed_mean(docs, vectors.filter("word = 'b'").selectExpr("word", "array(1.0D) as vector"), 2).collect()


def labelled(spark, x, y):
    from pyspark.ml.functions import array_to_vector

    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    frame = spark.createDataFrame(rows, "doc_id long, x array<double>, label int").repartition(3)
    return frame.select("doc_id", "label", array_to_vector("x").alias("features"))


def answers(model, df):
    return {r.doc_id: r.y_pred for r in predict(model, df).collect()}


def test_draws_follow_poisson():
    w = weights(np.arange(200_000), 3, 42)
    shares = np.bincount(w, minlength=4)[:4] / len(w)
    assert shares == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.005)
    assert (weights(np.arange(5), 4, 42) != weights(np.arange(5), 3, 42)).any()


def test_no_limit_of_depth(spark):
    """Rows that alternate between the classes along their only useful feature;
    a tree that draws every row tells all of them apart."""
    n = 240
    x = np.array([[2.0**-i if i < 60 else i, 5.0] for i in range(n)])
    y = np.arange(n) % 2
    df = labelled(spark, x, y)
    model = train_forest(df, trees=15, seed=1)
    got = answers(model, df)
    assert np.mean([got[i] == y[i] for i in range(n)]) > 0.85
    whole = grow(x, y.astype(float), np.ones(n), [1], 1)
    ends = walk(whole.arrays(), x)
    assert (np.array(whole.ones)[ends] == y).all()
    z = np.array([[float(3**i)] for i in range(80)])
    steps = grow(z, (np.arange(80) % 2).astype(float), np.ones(80), [1], 1)
    assert (np.array(steps.ones)[walk(steps.arrays(), z)] == np.arange(80) % 2).all()


def test_trees_deeper_than_thirty(spark):
    """Each value's weight outdoes all above it together, so Gini cuts them off
    one by one."""
    from pyspark.ml.functions import array_to_vector

    rows = []
    for level in range(45):
        rows += [(float(level), level % 2)] * int(1.25 ** (44 - level) + 1)
    df = labelled(spark, [[v] for v, _ in rows], [c for _, c in rows])
    model = train_forest(df, trees=4, seed=3)
    assert max(r.depth for r in tree_depths(model).collect()) > 30
    got = answers(model, df)
    assert np.mean([got[i] == c for i, (_, c) in enumerate(rows)]) > 0.98


def test_levels_and_subtrees_make_one_forest(spark):
    """Large nodes by histograms, small ones in tasks, and both ways to predict."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 6))
    x[:, 5] = 1.0
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] + 0.2 * x[:, 2] > 0)).astype(int)
    df, fresh = labelled(spark, x[:1000], y[:1000]), labelled(spark, x[1000:], y[1000:])
    scores = []
    for small in (20_000, 100):
        model = train_forest(df, trees=20, small=small)
        assert (model.tops.count() > 20) == (small == 100)
        got = answers(model, fresh)
        scores.append(np.mean([got[i] == y[1000 + i] for i in range(500)]))
        joined = {r.doc_id: r.y_pred for r in _predict_joined(model, fresh, rows_per_piece=90).collect()}
        assert joined == got and predict(model, fresh, broadcast_nodes=0).columns == ["doc_id", "label", "y_pred"]
        known = answers(model, df)
        assert np.mean([known[i] == y[i] for i in range(1000)]) > 0.97
    assert min(scores) > 0.88
    again = answers(train_forest(df.repartition(7), trees=20, small=100), fresh)
    assert again == got


def test_rows_of_one_file_are_read_by_many_tasks(spark, monkeypatch):
    from factlake.operators import forest

    made = []
    monkeypatch.setattr(forest, "_finished", lambda rows, *rest, own=forest._finished: made.append(rows) or own(rows, *rest))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    train_forest(labelled(spark, x, x[:, 0] > 0).coalesce(1), trees=2, small=50)
    files = {r.f for r in made[0].select(F.input_file_name().alias("f")).collect()}
    assert len(files) >= spark.sparkContext.defaultParallelism


def test_histograms_of_all_nodes_against_each_by_itself(spark):
    from factlake.operators import forest

    rng = np.random.default_rng(7)
    x, y = np.round(rng.normal(size=(300, 5)), 1), rng.integers(0, 2, 300)
    rows = [(i * 7919, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    frame = spark.createDataFrame(rows, "row long, x array<double>, y int").repartition(3)
    top = Nodes()
    top.cut(0, 1, 0.0, 1.0, top.add(0.5, "open"), top.add(0.5, "open"))
    top.cut(2, 0, 0.3, 1.0, top.add(0.5, "open"), top.add(0.5, "leaf"))
    top.stubborn.add(1)  # looks at all features
    cuts = [np.unique(np.quantile(x[:, f], [0.2, 0.5, 0.9])[: 3 - f % 2]) for f in range(5)]
    got = {tuple(r)[:4]: tuple(r)[4:] for r in forest._histograms(frame, [top], cuts, 2, 42).collect()}
    ids = np.array([r[0] for r in rows])
    w, ends, expected = weights(ids, 0, 42), walk(top.arrays(), x), {}
    for node, n in ((1, 5), (3, 2)):
        for f in np.random.default_rng([42, 0, node]).permutation(5)[:n]:
            for b in range(len(cuts[f]) + 1):
                own = (w > 0) & (ends == node) & (np.searchsorted(cuts[f], x[:, f]) == b)
                if own.any():
                    v = x[own, f]
                    expected[0, node, f, b] = (w[own].sum(), (w * y)[own].sum(), own.sum(), v.min(), v.max())
    assert got == expected


def test_alike_rows_one_class_and_no_rows(spark):
    same = labelled(spark, [[1.0, 2.0]] * 40, [0, 1, 1, 1] * 10)
    for small in (5, 100):
        model = train_forest(same, trees=5, small=small)
        assert set(answers(model, same).values()) == {1}
    one = labelled(spark, [[float(i)] for i in range(9)], [1] * 9)
    assert set(answers(train_forest(one, trees=3), one).values()) == {1}
    # all values of a large node in one bin
    narrow = labelled(spark, [[0.0]] * 500 + [[1e-9 * i] for i in range(60)], [0] * 500 + [i // 30 for i in range(60)])
    model = train_forest(narrow, trees=9, small=10)
    assert np.mean(list(answers(model, narrow).values())) == pytest.approx(30 / 560, abs=0.02)
    with pytest.raises(ValueError):
        train_forest(same.limit(0))
    assert Nodes().feature == [-1]


def test_emotions_of_a_large_lexicon_are_added_up_in_the_row(spark, monkeypatch):
    """common words of a lexicon too large to broadcast are not shuffled."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(FAKE + REAL + RARE, size=30)) for _ in range(40)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    affects = [(w, ft.EMOTIONS[i % 8]) for i, w in enumerate(FAKE + RARE)] + [("fear", "negative"), (None, "joy")]
    lexicon = spark.createDataFrame(affects, "word string, affect string")
    small = sorted(ft.emotion_scores(docs, lexicon).collect())
    joined, rows = [], []
    monkeypatch.setattr(scoring, "MAX_MATRIX_BYTES", 5 * 8 * 9)
    sums = ft.word_sums
    monkeypatch.setattr(ft, "word_sums", lambda *a: sums(*a, max_bytes=0, common=5))
    plain = scoring.lookup_join
    monkeypatch.setattr(
        scoring, "lookup_join", lambda left, *a, **k: (joined.append(k), rows.append(left.count()), plain(left, *a, **k))[2]
    )
    assert sorted(ft.emotion_scores(docs, lexicon).collect()) == small
    assert len(joined) == 1 and 0 < rows[0] < 40 * 30
    known = [[w for w in (t or "").split()] for t in texts]
    of = {w: [a for x, a in affects if x == w] for w in FAKE + REAL + RARE}
    for r, own in zip(small, known):
        found = [a for w in own for a in of[w]]
        assert [r[e] for e in ft.EMOTIONS] == [found.count(e) / max(1, len(found)) for e in ft.EMOTIONS]


def test_vocabulary_counts_each_text_once(spark):
    """totals and documents of a term are counted without counts by document."""
    texts = ["aa bb bb", "aa cc", "", None, "bb", "dd"]
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, content string")
    given = ft.vocabulary(docs, counts=ft.term_counts(docs)).collect()
    vocab = ft.vocabulary(docs)
    assert sorted(vocab.collect()) == sorted(given) == [("aa", 2, 2, 6), ("bb", 3, 2, 6)]
    plan = vocab._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_features_of_test_rows_are_cleaned_once(spark, sf, monkeypatch):
    """the query cleans each text once and writes it down."""
    from registry import features as queries

    given = []
    clean = baseline.cleaned
    monkeypatch.setattr(baseline, "cleaned", lambda df: (given.append(df), clean(df))[1])
    files = []
    change = baseline.FeatureModel.transform
    monkeypatch.setattr(
        baseline.FeatureModel, "transform", lambda self, docs: (files.append(docs.inputFiles()), change(self, docs))[1]
    )
    assert queries.baseline_features(spark, sf).filter("length <> 48 or not finite").isEmpty()
    assert len(given) == 2 and files and not any("documents.parquet" in f for f in files[0])
