"""The daily count of events as a streaming query (A1 for records that arrive over time)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_counts(stream: DataFrame, ts: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """Counts by day and keys; records later than the watermark are ignored."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.to_date("window.start").alias("date"), *keys, "n")


def run_available(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; Parquet, appended when a day is past the watermark."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
