"""Streams of measurements: idempotent ingest and daily buckets that late rows still join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.ingest import UNIQUE


def distinct_rows(stream: DataFrame, key: tuple[str, ...] = UNIQUE, at: str = "start_at", late: str = "7 days") -> DataFrame:
    """The first row of each key within the watermark; the state is bounded by it."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(key))


def daily(stream: DataFrame, at: str = "start_at", late: str = "7 days") -> DataFrame:
    """(account_id, metric, bucket, sum, count) by UTC day."""
    day = F.window(at, "1 day")
    out = stream.withWatermark(at, late).groupBy("account_id", "metric", day.alias("w")).agg(F.sum("value").alias("sum"), F.count("*").alias("count"))
    return out.select("account_id", "metric", F.to_date("w.start").alias("bucket"), "sum", "count")


def ingest(stream: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to sink(batch, number) until all that is there has been read. The sink must be idempotent: a batch may come twice."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
