"""Verdict JSON: what is valid, and how the rest is reported."""

from pyspark.sql import functions as F

from factlake.functions.verdict import encode_verdict, parse_verdict
from factlake.operators.scoring import align, parse_scores, score

GOOD = '{"label": "fake", "confidence": 0.5, "reasoning": "r"}'
CASES = [
    (GOOD, None, 0.5),
    ('{"label":"real","confidence":"0.25","reasoning":"r","more":[1]}', None, 0.25),
    ('{"label":"real","confidence":1,"reasoning":""}', None, 1.0),
    ('{"label":"real","confidence":true,"reasoning":""}', None, 1.0),
    ("", "empty", None),
    (None, "empty", None),
    ("not json", "not an object", None),
    ("[1]", "not an object", None),
    ('"fake"', "not an object", None),
    ('{"label": "fake", "confidence": 0.5, "reasoning": "r"', "not an object", None),
    ('{"label":"maybe","confidence":0.5,"reasoning":"r"}', "label", None),
    ('{"label":1,"confidence":0.5,"reasoning":"r"}', "label", None),
    ('{"confidence":0.5,"reasoning":"r"}', "label", None),
    ('{"label":"fake","confidence":1.5,"reasoning":"r"}', "confidence", None),
    ('{"label":"fake","confidence":-0.1,"reasoning":"r"}', "confidence", None),
    ('{"label":"fake","confidence":"nan","reasoning":"r"}', "confidence", None),
    ('{"label":"fake","confidence":null,"reasoning":"r"}', "confidence", None),
    ('{"label":"fake","reasoning":"r"}', "confidence", None),
    ('{"label":"fake","confidence":0.5}', "reasoning", None),
    ('{"label":"fake","confidence":0.5,"reasoning":7}', "reasoning", None),
]


def test_parse(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, raw string")
    rows = df.select("id", parse_verdict(F.col("raw")).alias("v")).select("id", "v.*").collect()
    assert len(rows) == len(CASES)
    for r in rows:
        _, error, confidence = CASES[r["id"]]
        assert (r["error"], r["confidence"]) == (error, confidence), CASES[r["id"]]
        assert r["is_valid"] == (error is None)
        assert (r["label"] is None) == (error is not None)


def test_encode(spark):
    df = spark.createDataFrame([("fake",), ("real",), ("other",), (None,)], "l string")
    assert [r[0] for r in df.select(encode_verdict(F.col("l"))).collect()] == [0, 1, 1, 1]


def test_failed_calls_are_reported_not_lost(spark):
    def scorer(row):
        if row["doc_id"] == 2:
            raise RuntimeError("model stopped")
        return GOOD if row["doc_id"] != 3 else ""

    df = spark.createDataFrame([(i,) for i in range(1, 6)], "doc_id int")
    parsed = parse_scores(score(df, scorer)).cache()
    assert parsed.count() == 5
    errors = {r["doc_id"]: r["error"] for r in parsed.filter("not is_valid").collect()}
    assert errors == {2: "RuntimeError: model stopped", 3: "empty"}
    truth = df.withColumn("label", F.col("doc_id") % 2)
    assert {r["doc_id"] for r in align(truth, parsed).collect()} == {1, 4, 5}
