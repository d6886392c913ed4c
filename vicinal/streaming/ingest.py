"""Structured Streaming over items and events: an extension of the batch operators.

Upserts arrive as JSON lines and are merged, batch by batch, into a collection (last write wins). A batch that is replayed after
a failure gives the same collection, as an upsert is idempotent.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vicinal.functions.distance import distance
from vicinal.functions.filters import compile_filter
from vicinal.sources.collection import Collection
from vicinal.sources.jsonl import from_lines


def upsert_stream(collection: Collection, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Merge the JSON-lines files that appear in ``folder`` into the collection."""
    lines = collection.spark.readStream.format("text").load(folder)

    def merge(batch: DataFrame, _number: int) -> None:
        if not batch.isEmpty():
            collection.upsert(from_lines(batch))

    writer = lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def filtered(stream: DataFrame, expr: Mapping[str, Any], metadata: str) -> DataFrame:
    """Rows of a stream whose JSON column passes a metadata filter."""
    return stream.filter(compile_filter(expr, F.expr(f"try_parse_json(`{metadata}`)")))


def within(stream: DataFrame, query: list[float], radius: float, metric: str = "cosine", vector: str = "vector") -> DataFrame:
    """Rows of a stream within ``radius`` of a query vector, with their distance."""
    return stream.withColumn("distance", distance(metric, F.col(vector), query)).filter(F.col("distance") <= radius)


def window_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", ts: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """Tumbling windows of events: start, by, n, total. Rows later than ``late`` are dropped by the watermark when streamed."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    grouped = rows.groupBy(F.window(ts, length).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), by, "n", "total")


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
