"""Candles from a stream of ticks: a bar is given out once it has closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_path

BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def stream_candles(ticks: DataFrame, seconds: int, lateness: str = "1 hour") -> DataFrame:
    """Bars from a streaming ``symbol, ts, price, event_id``; in append mode each
    appears when the watermark passes its end, so no unclosed bar is seen.
    Ticks later than ``lateness`` are dropped."""
    key = F.struct("ts", "event_id")
    bars = (
        ticks.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.count("*").cast("double").alias("volume"))
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def run_available(spark: SparkSession, ticks: DataFrame, seconds: int, lateness: str = "1 hour", folder: str | None = None) -> DataFrame:
    """Everything the stream holds now, as a Parquet table of closed bars in
    ``folder`` (one below ``spark.checkpoint.dir`` by default), which also has
    the stream's checkpoint: run again on the same folder, it goes on from there."""
    folder = folder or shared_path(spark, "stream")
    sink = stream_candles(ticks, seconds, lateness).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/bars").option("checkpointLocation", f"{folder}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(BARS).parquet(f"{folder}/bars")
