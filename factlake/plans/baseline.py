"""The linguistic baseline: features fitted on the training rows, a forest,
timed predictions on the test rows."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions.text import clean_text, compose_content, head_chars, words
from factlake.operators.evaluate import classification_metrics
from factlake.operators.features import (
    EMBEDDING_DIMS,
    TFIDF_DIMS,
    TfidfModel,
    assemble_features,
    emotion_scores,
    fit_tfidf,
)
from factlake.operators.forest import Forest, predict, train_forest
from factlake.operators.pca import PcaModel, fit_pca
from factlake.operators.scale import deal, materialize
from factlake.operators.scoring import embed_mean

HEAD_CHARS = 1000


def cleaned(news: DataFrame) -> DataFrame:
    """doc_id, label, content: the cleaned classifier input."""
    text = clean_text(compose_content(F.col("title"), F.col("text")))
    return news.select("doc_id", "label", text.alias("content"))


def mean_vectors(docs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """doc_id, v: mean word vector of the first characters, as an ML vector."""
    head = docs.select("doc_id", words(head_chars(F.col("content"), HEAD_CHARS)).alias("words"))
    return embed_mean(head, vectors, dim).select("doc_id", array_to_vector("vector").alias("v"))


@dataclass(frozen=True)
class FeatureModel:
    """Everything fitted on the training rows, plus the two lookup tables."""

    tfidf: TfidfModel
    tfidf_pca: PcaModel
    vector_pca: PcaModel
    vectors: DataFrame
    dim: int
    lexicon: DataFrame

    def transform(self, docs: DataFrame) -> DataFrame:
        """doc_id, features, label of cleaned documents."""
        sparse = self.tfidf.transform(docs, "content", "v").select("doc_id", "v")
        first = self.tfidf_pca.transform(sparse, "v", "tfidf").drop("v")
        dense = mean_vectors(docs, self.vectors, self.dim)
        second = self.vector_pca.transform(dense, "v", "emb").drop("v")
        third = emotion_scores(docs, self.lexicon)
        features = assemble_features(first, second, third)
        return features.join(docs.select("doc_id", "label"), "doc_id")


def fit_features(
    docs: DataFrame, vectors: DataFrame, dim: int, lexicon: DataFrame
) -> FeatureModel:
    tfidf = fit_tfidf(docs)
    sparse = tfidf.transform(docs, "content", "v")
    dense = mean_vectors(docs, vectors, dim)
    return FeatureModel(
        tfidf,
        fit_pca(sparse, "v", TFIDF_DIMS),
        fit_pca(dense, "v", EMBEDDING_DIMS),
        vectors,
        dim,
        lexicon,
    )


@dataclass(frozen=True)
class BaselineRun:
    predictions: DataFrame
    metrics: DataFrame
    latency_mean_sec: float
    features: FeatureModel
    forest: Forest


def run_baseline(
    train: DataFrame, test: DataFrame, vectors: DataFrame, dim: int, lexicon: DataFrame
) -> BaselineRun:
    """Fits on `train`, predicts `test`. The latency is the time of feature
    extraction and prediction of the test rows over their number."""
    train_docs = materialize(cleaned(train), "train")
    features = fit_features(train_docs, vectors, dim, lexicon)
    forest = train_forest(materialize(features.transform(train_docs), "features"))
    start = time.perf_counter()
    test_docs = materialize(cleaned(test), "test")
    test_features = materialize(deal(features.transform(test_docs), "doc_id"), "features")
    scored = materialize(predict(forest, test_features), "predictions")
    seconds = time.perf_counter() - start
    predictions = scored.withColumnRenamed("label", "y_true")
    latency = seconds / max(1, predictions.count())
    metrics = classification_metrics(predictions)
    return BaselineRun(predictions, metrics, latency, features, forest)
