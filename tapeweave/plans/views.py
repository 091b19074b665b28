"""Inputs of the registered queries, and the same inputs as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.candles import from_ticks, integer_walk

HOUR = 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: the type is the symbol, the value the price."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))


def bars(spark: SparkSession, sf_dir: str, seconds: int = HOUR) -> DataFrame:
    """Hourly candles of every event type."""
    return from_ticks(ticks(spark, sf_dir), seconds, order=("ts", "event_id"))


def walk(spark: SparkSession, sf_dir: str, seconds: int = HOUR) -> DataFrame:
    """Candles of the integer walk over all events."""
    return from_ticks(integer_walk(table(spark, sf_dir, "events")), seconds, order=("ts", "event_id"))


def two_walks(spark: SparkSession, sf_dir: str, seconds: int = HOUR) -> DataFrame:
    """Candles of two integer walks: over clicks and views, and over the rest."""
    e = table(spark, sf_dir, "events")
    first = F.coalesce(F.col("event_type").isin("click", "view"), F.lit(False))
    both = integer_walk(e.where(first), "CLICKS").unionByName(integer_walk(e.where(~first), "OTHERS"))
    return from_ticks(both, seconds, order=("ts", "event_id"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A funding-like series at irregular times: scaled values of ``error`` events, for ``ALL``."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(F.lit("ALL").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), ((F.col("value") - 50) / 10000).alias("funding"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade table derived from orders, for the metrics: whole numbers of the
    key and the price give gains, sides and levels."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pnl = (F.expr("CAST(round(o_totalprice * 100) AS BIGINT) % 2001") - 900) / 100000
    return o.select(
        k.alias("seq"), F.col("o_orderdate").cast("timestamp").alias("exit_ts"), F.when(k % 2 == 0, "long").otherwise("short").alias("direction"),
        F.when(k % 3 == 0, "val").when(k % 3 == 1, "poc").otherwise("vah").alias("level"), F.when(k % 7 == 0, F.lit(None)).otherwise((k % 5).cast("int")).alias("score"),
        pnl.alias("pnl_pct"), (pnl / 0.01).alias("pnl_r"), (-(k % 50) / 1000).alias("mae_pct"), (k % 90 / 1000).alias("mfe_pct"), (k % 333).alias("bars"),
        (F.lit(10000.0) + F.expr("CAST(round(o_totalprice) AS BIGINT) % 4001")).alias("capital_after"), (k % 11 / 4).alias("mfe_atr"),
    )


def seconds(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as whole epoch seconds named ``<column>_s``."""
    for c in columns:
        df = df.withColumn(f"{c}_s", F.unix_seconds(c)).drop(c)
    return df


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; negative zero made zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


SQL_BARS = """bars AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""
SQL_WALK_TICKS = """cents AS (SELECT event_id, ts, CAST(round(value * 100) AS BIGINT) AS c FROM events),
walk_ticks AS (
  SELECT 'ALL' AS symbol, ts, event_id, 10000 + sum(c - (SELECT CAST(sum(c) // count(*) AS BIGINT) FROM cents)) OVER (ORDER BY ts, event_id) / 100.0 AS price FROM cents)"""


def sql_walk(step: str = "1 HOUR", name: str = "walk") -> str:
    return f"""{name} AS (
  SELECT symbol, time_bucket(INTERVAL {step}, ts) AS ts, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM walk_ticks GROUP BY 1, 2)"""


SQL_RATES = "rates AS (SELECT 'ALL' AS symbol, ts, (value - 50) / 10000 AS funding FROM events WHERE event_type = 'error')"
SQL_TRADES = """t0 AS (SELECT *, o_orderkey AS k, (CAST(round(o_totalprice * 100) AS BIGINT) % 2001 - 900) / 100000 AS pnl FROM orders),
trades AS (
  SELECT k AS seq, CAST(o_orderdate AS TIMESTAMP) AS exit_ts, CASE WHEN k % 2 = 0 THEN 'long' ELSE 'short' END AS direction,
    CASE k % 3 WHEN 0 THEN 'val' WHEN 1 THEN 'poc' ELSE 'vah' END AS level, CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(k % 5 AS INTEGER) END AS score,
    pnl AS pnl_pct, pnl / 0.01 AS pnl_r, -(k % 50) / 1000 AS mae_pct, k % 90 / 1000 AS mfe_pct, k % 333 AS bars,
    10000.0::DOUBLE + CAST(round(o_totalprice) AS BIGINT) % 4001 AS capital_after, k % 11 / 4 AS mfe_atr
  FROM t0)"""
