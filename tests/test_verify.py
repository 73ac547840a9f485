"""Verification and ablation on small hand-made tables."""

import json

import pytest
from pyspark.sql import functions as F

from factlake.functions.encoders import hashing_encoder
from factlake.functions.prompt import SYSTEM_PROMPT
from factlake.operators import scoring
from factlake.operators.grid import config_grid
from factlake.operators.scoring import embed
from factlake.plans import ablation, verify
from factlake.settings import Settings
from factlake.sources import tables as tb
from factlake.streaming.verify_stream import verify_stream

KB = [
    (1, "real one {query}", 1, [1.0, 0.0]),
    (2, "real two", 1, [0.9, 0.1]),
    (3, "fake one", 0, [0.0, 1.0]),
    (4, "fake two", 0, [0.1, 0.9]),
    (5, "no direction", 0, [0.0, 0.0]),
]
NEWS = [(10, "near real", [1.0, 0.05]), (11, "near fake {context}", [0.0, 1.0]), (12, "lost", None)]


@pytest.fixture(scope="module")
def kb(spark):
    return spark.createDataFrame(KB, "vec_id long, content string, label int, embedding array<double>")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(NEWS, "query_id long, news string, embedding array<double>")


def test_vote(kb, queries):
    out = verify.verify(queries, kb, Settings(top_k=2))
    rows = {r["query_id"]: r for r in out.collect()}
    assert (rows[10]["verdict"], rows[11]["verdict"], rows[12]["verdict"]) == ("real", "fake", "fake")
    assert rows[10]["confidence"] == 1.0 and rows[12]["confidence"] == 0.0
    assert "[1] real one {query}\n\n[2] real two" in rows[10]["prompt"]
    assert "near fake {context}" in rows[11]["prompt"]
    assert [d["vec_id"] for d in rows[11]["docs"]] == [3, 4]
    assert rows[12]["reasoning"] == "no neighbour is near enough"


def test_empty_knowledge_base(kb, queries):
    out = verify.verify(queries, kb.limit(0), Settings()).collect()
    assert len(out) == 3 and {r["verdict"] for r in out} == {"fake"}


def test_scorer_and_log(spark, kb, queries, tmp_path):
    def scorer(request):
        if "lost" in request["prompt"]:
            return "{"
        return json.dumps({"label": "real", "confidence": 0.5, "reasoning": str(request["temperature"])})

    settings = Settings(top_k=1, temperature=0.3)
    out = verify.verify(queries, kb, settings, scorer)
    rows = {r["query_id"]: r for r in out.collect()}
    assert rows[12]["error"] == "not an object" and not rows[12]["is_valid"]
    assert rows[10]["reasoning"] == "0.3" and rows[10]["latency_sec"] >= 0
    path = str(tmp_path / "log")
    tb.log_verifications(out, path)
    logged = tb.read_verifications(spark, path).collect()
    assert len(logged) == 2
    one = next(r for r in logged if r["news_content"] == "near real")
    docs = json.loads(one["retrieved_docs"])
    assert len(docs) == 1 and docs[0][:2] == ["real one {query}", 1] and docs[0][2] < 0.01
    assert SYSTEM_PROMPT in one["prompt"] and "near real" in one["prompt"]


@pytest.mark.parametrize(
    "bad", [{"top_k": 0}, {"temperature": 1.1}, {"chunk_type": "half"}, {"chunk_overlap": 256}]
)
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        Settings(**bad)


def variants(kb, queries):
    kbs = {(e, c): kb for e in ("EMB-A", "EMB-B") for c in ("CHUNK-A", "CHUNK-B")}
    return {"EMB-A": queries, "EMB-B": queries}, kbs


def test_ablation_with_scorer_resumes(spark, kb, queries, tmp_path):
    def scorer(request):
        if request["config_id"] == 3 or (request["config_id"] == 4 and request["query_id"] == 10):
            raise RuntimeError("stopped")
        label = "real" if "[1] real" in request["prompt"] else "fake"
        return json.dumps({"label": label, "confidence": 1, "reasoning": str(request["num_ctx"])})

    truth = spark.createDataFrame([(10, 1), (11, 0), (12, 1)], "doc_id long, label int")
    own, kbs = variants(kb, queries)
    grid = config_grid(spark)
    path = str(tmp_path / "results")
    table = ablation.run_ablation(grid, None, own, kbs, truth, path, scorer)
    rows = {r["config_id"]: r for r in table.collect()}
    assert len(rows) == 31 and 3 not in rows  # a configuration without an answer is left out
    assert rows[4]["n_scored"] == 2 and rows[1]["n_scored"] == 3
    # the article without a vector finds the first documents, which are real
    assert rows[1]["accuracy"] == 1.0 and rows[1]["latency_mean_sec"] >= 0
    done = tb.read_results(spark, path)
    again = ablation.run_ablation(grid, done, own, kbs, truth)
    assert [r["config_id"] for r in again.collect()] == [3]


def test_resumed_ablation_searches_open_variants_only(spark, kb, queries, tmp_path, monkeypatch):
    searched, search = [], ablation.nearest_documents

    def counted(*args, **kwargs):
        searched.append(args)
        return search(*args, **kwargs)

    monkeypatch.setattr(ablation, "nearest_documents", counted)
    truth = spark.createDataFrame([(10, 1), (11, 0), (12, 1)], "doc_id long, label int")
    own, kbs = variants(kb, queries)
    grid, store = config_grid(spark), str(tmp_path / "store")
    some = {v: kbs[v] for v in list(kbs)[:3]}
    ablation.run_ablation(grid, None, own, some, truth, store=store).collect()
    assert len(searched) == 3
    again = ablation.run_ablation(grid, None, own, kbs, truth, store=store).drop("latency_mean_sec")
    assert len(searched) == 4  # the variant that the stopped run lacks
    plain = ablation.run_ablation(grid, None, own, kbs, truth).drop("latency_mean_sec")
    assert sorted(map(str, again.collect())) == sorted(map(str, plain.collect()))
    ablation.run_ablation(grid, None, own, kbs, truth, store=store, max_k=11).collect()
    assert len(searched) == 12  # another k is another search


def test_smaller_k_is_a_prefix(spark, kb, queries):
    own, kbs = variants(kb, queries)
    wide = ablation.retrieve_variants(own, kbs, 4).filter("embedding = 'EMB-A' and chunking = 'CHUNK-A'")
    narrow = ablation.retrieve_variants(own, kbs, 2).filter("embedding = 'EMB-A' and chunking = 'CHUNK-A'")
    a = {r["query_id"]: [d["vec_id"] for d in r["docs"]][:2] for r in wide.collect()}
    assert a == {r["query_id"]: [d["vec_id"] for d in r["docs"]] for r in narrow.collect()}


def test_stream_equals_batch(spark, tmp_path):
    texts = [f"word{i % 7} word{i % 3} text {i}" for i in range(30)]
    corpus = embed(
        spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "vec_id long, content string, label int"),
        hashing_encoder(),
    ).cache()
    news = spark.createDataFrame([(i, f"word{i} text") for i in range(9)], "query_id long, news string")
    arrivals, log = str(tmp_path / "in"), str(tmp_path / "log")
    news.repartition(3).write.parquet(arrivals)
    stream = spark.readStream.schema(news.schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
    verify_stream(stream, corpus, hashing_encoder(), Settings(), log, str(tmp_path / "c")).awaitTermination()
    batch = verify.verify(embed(news, hashing_encoder(), column="news"), corpus, Settings())
    want = sorted((r["news"], r["verdict"], r["confidence"]) for r in batch.collect())
    logged = tb.read_verifications(spark, log).collect()
    assert sorted((r["news_content"], r["label"], r["confidence"]) for r in logged) == want
    assert len(want) == 9
    assert tb.read_verifications(spark, log).filter(F.col("created_at").isNull()).count() == 0


def counted(spark):
    """A count that every Python worker adds to."""
    return spark.sparkContext.accumulator(0)


def test_models_are_called_once_per_article(spark, kb):
    texts, calls = counted(spark), counted(spark)

    def encoder(batch):
        texts.add(len(batch))
        return [[1.0, float(len(t))] for t in batch]

    def scorer(request):
        calls.add(1)
        return json.dumps({"label": "real", "confidence": 1, "reasoning": ""}), "thought"

    news = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "query_id long, news string")
    queries = embed(news, encoder, column="news")
    out = verify.verify(queries, kb, Settings())
    assert out.count() == 10 and texts.value == 10
    out = verify.verify(queries, kb, Settings(), scorer)
    assert {r["thinking"] for r in out.collect()} == {"thought"} and out.count() == 10
    assert (texts.value, calls.value) == (20, 10)
    truth = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, label int")
    kbs = {("EMB-A", c): kb for c in ("CHUNK-A", "CHUNK-B")}
    grid = config_grid(spark).filter("embedding = 'EMB-A'")
    assert ablation.run_ablation(grid, None, {"EMB-A": queries}, kbs, truth, scorer=scorer).count() == 16
    # the query vectors and, once more, the articles' texts
    assert texts.value <= 40 and calls.value == 10 + 160


def test_stream_calls_once(spark, kb, tmp_path):
    texts = counted(spark)

    def encoder(batch):
        texts.add(len(batch))
        return [[1.0, float(len(t))] for t in batch]

    news = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "query_id long, news string")
    news.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(news.schema).parquet(str(tmp_path / "in"))
    verify_stream(stream, kb, encoder, Settings(), str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination()
    assert texts.value == 6


def test_settings_of_an_article(kb, queries):
    own = queries.withColumn("top_k", F.when(F.col("query_id") == 10, 4).cast("int"))
    rows = {r["query_id"]: r for r in verify.verify(own, kb, Settings(top_k=1)).collect()}
    assert (len(rows[10]["docs"]), len(rows[11]["docs"])) == (4, 1)
    with pytest.raises(ValueError):
        verify.verify(queries.withColumn("top_k", F.lit(0)), kb, Settings())


def test_scorer_gets_few_rows_at_a_time_and_nulls_as_they_are(spark):
    """Only the request is made of Python objects; other columns pass by."""
    rows = [(i, f"p{i}", None if i % 2 else i, [float(i), None]) for i in range(600)]
    df = spark.createDataFrame(rows, "query_id long, prompt string, n int, other array<double>").coalesce(1)

    def scorer(request):
        assert set(request) == {"query_id", "prompt", "n"} and "pandas" not in type(request["n"]).__module__
        return f"{request['n']}", request["prompt"]

    out = scoring.score(df, scorer, request=["query_id", "prompt", "n"]).collect()
    assert [(r.query_id, r.raw, r.thought, r.other) for r in sorted(out)] == [
        (i, str(n), p, o) for i, p, n, o in rows
    ]
    assert all(r.call_error is None and r.latency_sec >= 0 for r in out)
