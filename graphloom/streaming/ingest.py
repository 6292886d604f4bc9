"""Streams (beyond the reference): documents into triples batch by batch, and windowed event counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import triples as T


def ingest(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the document triples of a stream (doc_id, text, source_type, created_at), partitioned by predicate."""
    rows = T.document_triples(documents)
    return rows.writeStream.format("parquet").partitionBy("p").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window; state older than the watermark is dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
