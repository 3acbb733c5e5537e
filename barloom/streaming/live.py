"""The same operators on streams: tumbling bars, session clusters, running means by state, first-wins deduplication."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_stream(spark, folder: str, schema) -> DataFrame:
    """Parquet files of events as a stream; ``ts`` becomes an instant, as watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def live_bars(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Finished bars per event type; rows later than ``late`` are dropped by the watermark."""
    made = events.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("event_type").alias("symbol"))
    return made.agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count(F.lit(1)).alias("volume")
    ).select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def sliding_means(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    made = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), F.col("event_type").alias("symbol"))
    return made.agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")).select("symbol", F.col("window.end").alias("ts"), "mean", "n")


def live_clusters(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    made = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), F.col("event_type").alias("symbol"))
    return made.agg(F.count(F.lit(1)).alias("n")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def first_per_id(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of an event_id within the watermark (batch keeps the last one instead)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_ema(events: DataFrame, span: int = 20) -> DataFrame:
    """EMA of the values per event type in arrival order, its state kept between batches."""
    k = 2 / (span + 1)

    def step(key, frames: Iterator, state):
        import pandas as pd

        now, n = state.get if state.exists else (None, 0)
        for frame in frames:
            for x in frame.sort_values("ts")["value"]:
                now, n = (float(x) if now is None else now + k * (float(x) - now)), n + 1
        state.update((now, n))
        yield pd.DataFrame({"symbol": [key[0]], "ema": [now], "n": [n]})

    return events.select("event_type", "ts", "value").groupBy("event_type").applyInPandasWithState(step, "symbol string, ema double, n long", "ema double, n long", "update", "NoTimeout")
