"""Life cycle of the knowledge base: resume, rollback, snapshots, streams."""

import pytest
from pyspark.sql import functions as F

from factlake.functions.encoders import hashing_encoder
from factlake.operators import kb as state
from factlake.operators.chunking import backfill_full, backfill_source_index
from factlake.operators.scoring import embed
from factlake.plans import index, verify
from factlake.schemas import NEWS
from factlake.settings import Settings
from factlake.sources import files
from factlake.sources import kb as store
from factlake.sources import news as src
from factlake.sources import versions
from factlake.streaming.index_stream import index_stream, news_stream

ENCODERS = {"EMB-A": hashing_encoder(0), "EMB-B": hashing_encoder(1)}


def rows(kb):
    return sorted(
        (r["embedding_model"], r["chunking"], r["source_index"], r["chunk_no"], r["content"], r["label"],
         tuple(r["embedding"]))
        for r in kb.collect()
    )


@pytest.fixture(scope="module")
def news(spark):
    texts = [None, "", "one two", " ".join(f"w{i}" for i in range(257))]
    data = [
        (i, None if i % 5 == 0 else f"title {i}", texts[i % 4], i % 2, "train") for i in range(20)
    ]
    return spark.createDataFrame(data, NEWS).cache()


@pytest.fixture(scope="module")
def clean(spark, news, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("kb"))
    assert index.build_kb(news, path, ENCODERS) == 1
    return rows(store.read_kb(spark, path))


def test_build_in_parts(spark, news, clean, tmp_path):
    assert index.build_kb(news, str(tmp_path / "kb"), ENCODERS, rows_per_commit=6) == 4
    kb = store.read_kb(spark, str(tmp_path / "kb"))
    assert rows(kb) == clean
    assert {(r["embedding_model"], r["chunking"]) for r in kb.collect()} == set(index.variants_of(ENCODERS))


class Broken:
    """An encoder that stops at a document."""

    def __init__(self, word):
        self.word = word

    def __call__(self, texts):
        if any(self.word in t for t in texts):
            raise RuntimeError("model stopped")
        return hashing_encoder(1)(texts)


def test_killed_and_resumed(spark, news, clean, tmp_path):
    path = str(tmp_path / "kb")
    with pytest.raises(Exception, match="model stopped"):
        index.build_kb(news, path, {**ENCODERS, "EMB-B": Broken("title 14")}, rows_per_commit=6)
    assert index.resume_point(spark, path, ENCODERS) == 11
    assert index.build_kb(news, path, ENCODERS, rows_per_commit=6) == 2
    assert rows(store.read_kb(spark, path)) == clean
    assert index.build_kb(news, path, ENCODERS, rows_per_commit=6) == 0


def test_unfinished_folder_is_not_read(spark, news, clean, tmp_path):
    path = str(tmp_path / "kb")
    index.build_kb(news.filter("source_index < 10"), path, ENCODERS, rows_per_commit=5)
    (tmp_path / "kb" / "batch=000000000005" / "_SUCCESS").unlink()
    assert index.resume_point(spark, path, ENCODERS) == 4
    index.build_kb(news, path, ENCODERS, rows_per_commit=5)
    assert rows(store.read_kb(spark, path)) == clean


def test_checkpoint_and_rollback(spark):
    data = [("EMB-A", "CHUNK-A", i) for i in (0, 1, 2, 3)] + [("EMB-A", "CHUNK-B", 1), ("EMB-A", "CHUNK-B", None)]
    kb = spark.createDataFrame(data, "embedding_model string, chunking string, source_index long")
    both = [("EMB-A", "CHUNK-A"), ("EMB-A", "CHUNK-B")]
    assert state.index_checkpoint(kb, both).first()[0] == 1
    assert index.consistent_kb(kb, both).count() == 3
    assert state.index_checkpoint(kb, [*both, ("EMB-B", "CHUNK-A")]).first()[0] == -1
    assert state.index_checkpoint(store.empty_kb(spark), both).first()[0] == -1


def test_snapshots(spark, news, clean, tmp_path):
    path, root = str(tmp_path / "kb"), str(tmp_path / "snapshots")
    assert store.restore_kb(spark, root).count() == 0
    index.build_kb(news, path, ENCODERS, rows_per_commit=10, snapshot_root=root, snapshot_every=1)
    assert rows(store.restore_kb(spark, root)) == clean
    store.snapshot_kb(store.read_kb(spark, path).limit(1), root, "9999-01-01-00-00-00")
    assert store.restore_kb(spark, root).count() == 1


def test_scan_prunes_folders(spark, news, tmp_path):
    path = str(tmp_path / "kb")
    index.build_kb(news, path, ENCODERS)
    one = store.read_kb(spark, path, "EMB-B", "CHUNK-A")
    assert one.count() == 20
    plan = one.select("source_index")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(embedding_model" in plan
    assert "ReadSchema: struct<source_index:bigint>" in plan


def test_indexed_articles_find_themselves(spark, news, tmp_path):
    """From articles to a verdict, through the stored knowledge base."""
    path = str(tmp_path / "kb")
    index.build_kb(news, path, ENCODERS)
    for chunking in ("CHUNK-A", "CHUNK-B"):
        kb = store.with_vec_id(store.read_kb(spark, path, "EMB-A", chunking))
        assert kb.select("vec_id").distinct().count() == kb.count()
        asked = kb.filter("chunk_no = 0").select(F.col("source_index").alias("query_id"), F.col("content").alias("news"))
        queries = embed(asked, hashing_encoder(0), column="news")
        out = verify.verify(queries, kb, Settings(top_k=1)).filter("size(docs) = 1")
        near = out.select("query_id", F.col("docs")[0]["distance"].alias("d"))
        assert near.filter("d is not null and d > 1e-6").count() == 0
        assert out.count() == asked.count()


def test_stream_equals_batch(spark, news, clean, tmp_path):
    arrivals, path = str(tmp_path / "in"), str(tmp_path / "kb")
    news.filter("source_index < 12").repartition(3).write.parquet(arrivals)
    for _ in range(2):
        index_stream(
            news_stream(spark, arrivals, 1), path, ENCODERS, str(tmp_path / "checkpoint")
        ).awaitTermination()
        if _ == 0:
            news.filter("source_index >= 12").write.mode("append").parquet(arrivals)
    assert rows(store.read_kb(spark, path)) == clean


def test_backfill_of_whole_articles(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "id long, content string")
    assert [r["source_index"] for r in backfill_full(chunks).collect()] == [0, 1]


def test_splits_are_cached_once(spark, news, tmp_path):
    path = str(tmp_path / "news")
    src.cache_splits(news, path)
    src.cache_splits(news.limit(0), path)
    train = src.read_news(spark, path, "train")
    assert train.count() == 20
    assert train.filter("source_index = 5").first()["content"] == " "
    assert files.is_committed(spark, path)
    assert src.read_news(spark, path, "test").count() == 0


def test_documents_of_several_kinds(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\x00ü".encode())
    (tmp_path / "b.rev").write_bytes(b"cba")
    read = src.read_documents(spark, f"{tmp_path}/*", {"rev": lambda b: b.decode()[::-1]})
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in read.collect()}
    assert got == {"a.txt": "éü", "b.rev": "abc"}
    plain = src.read_documents(spark, f"{tmp_path}/*.txt").collect()
    assert [r["text"] for r in plain] == ["éü"]


def test_chunk_ids_do_not_run_into_the_next_document(spark):
    from factlake.sources.kb import with_vec_id

    rows = spark.createDataFrame([(1, 0), (1, (1 << 20) - 1), (2, 0)], "source_index long, chunk_no int")
    assert len({r.vec_id for r in with_vec_id(rows).collect()}) == 3
    many = spark.createDataFrame([(1, 1 << 20)], "source_index long, chunk_no int")
    with pytest.raises(Exception, match="chunks"):
        with_vec_id(many).collect()


def test_ranges_meet_ids_in_bins(spark):
    """Overlapping, empty, long and touching ranges, and ids in none."""
    ranges = [(0, 3, 1, 3), (1, 0, 4, 3), (2, 200, 4, 203), (3, 5, 150, 154), (4, 1, 204, 204), (5, 64, 1000, 1063)]
    frame = spark.createDataFrame(ranges, "source_index long, n_chunks int, first_id long, last_id long")
    ids = [0, 1, 3, 4, 63, 64, 149, 150, 154, 155, 203, 204, 205, 999, 1000, 1063, 1064, -5]
    chunks = spark.createDataFrame([(i, f"c{i}", None) for i in ids], "id long, content string, source_index long")
    expected = []
    for i in ids:
        own = [s for s, n, a, b in ranges if n and a <= i <= b]
        expected += [(i, f"c{i}", s) for s in own or [None]]
    for width in (1, 16, 64, 10_000):
        out = backfill_source_index(chunks, frame, width)
        assert sorted(map(tuple, out.select("id", "content", "source_index").collect()), key=str) == sorted(expected, key=str)
    plan = backfill_source_index(chunks, frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "div 64" in plan and plan.count("Generate") == 1


def test_positions_as_bitmaps(spark):
    """Gaps inside and behind a bucket, NULL and absent positions."""
    held = [i for i in range(70_000) if i not in (5, 40_000, 65_536)]
    rows = [("A", "x", i) for i in held] + [("A", "x", None), ("A", "x", 12)] + [("B", "x", i) for i in range(33_000)]
    kb = spark.createDataFrame(rows, "embedding_model string, chunking string, source_index long")
    docs = spark.range(70_005).select(F.col("id").alias("source_index"), F.lit("t").alias("bits"))
    own = kb.filter("embedding_model = 'A'")
    gone = state.missing_documents(docs, own)
    assert gone.columns == docs.columns
    assert sorted(r.source_index for r in gone.collect()) == [5, 40_000, 65_536, *range(70_000, 70_005)]
    assert state.missing_documents(docs, own.limit(0)).count() == 70_005
    unknown = spark.createDataFrame([(None, "t"), (7, "t")], "source_index long, bits string")
    assert [r.source_index for r in state.missing_documents(unknown, own).collect()] == [None]

    def prefix(kb, *variants):
        return state.common_prefix(kb, variants).first()["prefix"]

    a, b, c = ("A", "x"), ("B", "x"), ("C", "x")
    assert prefix(kb, a) == 4 and prefix(kb, b) == 32_999 and prefix(kb, a, b) == 4 and prefix(kb, a, c) == -1
    filled = kb.unionByName(spark.createDataFrame([("A", "x", 5)], kb.schema))
    assert prefix(filled, a) == 39_999 and prefix(filled, a, b) == 32_999 and prefix(filled.limit(0), a) == -1
    whole = kb.filter("embedding_model = 'B' AND source_index < 32768")
    assert prefix(whole, b) == 32_767


def data_files(path):
    return sorted(str(p) for p in path.rglob("*.parquet") if "_versions" not in str(p))


def test_versions_write_no_data(spark, news, tmp_path):
    path = str(tmp_path / "kb")
    index.build_kb(news.filter("source_index < 12"), path, ENCODERS, rows_per_commit=6)
    before = data_files(tmp_path)
    first = versions.snapshot(spark, path)
    whole = rows(store.read_kb(spark, path))
    back = versions.roll_back(spark, path, 7)
    assert {r[2] for r in rows(store.read_kb(spark, path))} == set(range(8)) and index.resume_point(spark, path, ENCODERS) == 7
    versions.delete_range(spark, path, 2, 3)
    assert {r[2] for r in rows(store.read_kb(spark, path))} == {0, 1, 4, 5, 6, 7}
    versions.restore(spark, path, first)
    assert rows(store.read_kb(spark, path)) == whole and data_files(tmp_path) == before
    assert {r[2] for r in rows(store.read_kb(spark, path, version=back))} == set(range(8))
    plan = store.read_kb(spark, path, version=back)._jdf.queryExecution().toString()
    assert "LessThan(source_index,8)" in plan  # reaches the scan


def test_positions_rolled_back_are_indexed_again(spark, news, clean, tmp_path):
    """Batches of the same name do not replace what older versions hold."""
    path = str(tmp_path / "kb")
    index.build_kb(news, path, ENCODERS, rows_per_commit=6)
    whole = versions.snapshot(spark, path)
    versions.roll_back(spark, path, 5)
    held = data_files(tmp_path)
    assert index.build_kb(news, path, ENCODERS, rows_per_commit=6) == 3
    assert set(held) < set(data_files(tmp_path))
    assert rows(store.read_kb(spark, path)) == clean == rows(store.read_kb(spark, path, version=whole))


def test_unfinished_version_and_unknown_positions(spark, news, tmp_path):
    path = str(tmp_path / "kb")
    index.build_kb(news.filter("source_index < 5"), path, ENCODERS)
    lost = store.read_kb(spark, path).limit(3).withColumn("source_index", F.lit(None).cast("long"))
    store.write_kb(lost, path, "lost")
    assert store.read_kb(spark, path).filter("source_index IS NULL").count() == 3
    versions.delete_range(spark, path, 4)
    assert store.read_kb(spark, path).filter("source_index IS NULL").count() == 3
    last = versions.roll_back(spark, path, 3)
    assert store.read_kb(spark, path).filter("source_index IS NULL OR source_index > 3").isEmpty()
    (tmp_path / "kb" / "_versions" / f"version={last}" / "_SUCCESS").unlink()
    assert store.read_kb(spark, path).filter("source_index IS NULL").count() == 3
    assert store.read_kb(spark, str(tmp_path / "none")).count() == 0
