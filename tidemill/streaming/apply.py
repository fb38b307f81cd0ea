"""Fitted chains and scorers are plain projections and filters, so a stream can pass
through them as it is: no state, no watermark and nothing fitted on the stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemill.plans.chain import FittedChain
from tidemill.plans.experiment import Scorer


def clean_stream(stream: DataFrame, chain: FittedChain) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return chain.apply(stream)


def score_stream(stream: DataFrame, scorer: Scorer, keep: Sequence[str]) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return scorer.transform(stream, keep)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, then stop; files and offsets are written exactly once."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
