"""Verification of arriving articles against a fixed knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from factlake.operators.ivf import ListIndex
from factlake.operators.scoring import Encoder, Scorer, embed
from factlake.plans.verify import verify
from factlake.settings import Settings
from factlake.sources.tables import log_verifications


def verify_stream(
    articles: DataFrame,
    kb: DataFrame,
    encoder: Encoder,
    settings: Settings,
    log_path: str,
    checkpoint: str,
    scorer: Scorer | None = None,
    index: ListIndex | None = None,
) -> StreamingQuery:
    """Verifies (query_id, news) rows that have arrived and logs the verdicts,
    one replaceable folder per batch."""

    def run(batch: DataFrame, number: int) -> None:
        # a few files that have arrived are a few splits
        cores = batch.sparkSession.sparkContext.defaultParallelism
        queries = embed(batch.repartition(2 * cores, "query_id"), encoder, column="news")
        verified = verify(queries, kb, settings, scorer, index=index)
        log_verifications(verified, f"{log_path}/batch={number}", mode="overwrite")

    return (
        articles.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
