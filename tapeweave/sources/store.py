"""Candle storage: one Parquet table partitioned by symbol and timeframe, read
through; CSV in and out; symbol translation."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CANDLES, OHLCV


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which all executors share.  A
    session on one machine (tests) may leave it unset and gets one under
    ``/tmp``; on a cluster its absence is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/tapeweave-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: what several plans
    start from is worked out once, and outlives any executor."""
    path = shared_path(df.sparkSession, "part")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def safe_name(symbol: str) -> str:
    """A symbol as it may stand in a path."""
    return re.sub(r"[^A-Za-z0-9_.-]", "-", symbol)


def write_candles(candles: DataFrame, path: str, timeframe: str, mode: str = "append") -> None:
    """Adds ``candles`` to the table, in folders by symbol and timeframe."""
    names = F.regexp_replace("symbol", r"[^A-Za-z0-9_.-]", "-")
    candles.withColumn("tf", F.lit(timeframe)).withColumn("symbol_dir", names).write.mode(mode).partitionBy("symbol_dir", "tf").parquet(path)


def read_candles(spark: SparkSession, path: str, symbols: list[str] | None = None, timeframes: list[str] | None = None) -> DataFrame:
    """Candles of the wanted symbols and timeframes; Spark opens their folders
    only.  Symbols that share a folder are told apart by their rows."""
    df = spark.read.schema(CANDLES + ", symbol_dir string, tf string").parquet(path)
    if symbols is not None:
        df = df.where(F.col("symbol_dir").isin([safe_name(s) for s in dict.fromkeys(symbols)]) & F.col("symbol").isin(list(dict.fromkeys(symbols))))
    if timeframes is not None:
        df = df.where(F.col("tf").isin(list(dict.fromkeys(timeframes))))
    return df.select("symbol", "tf", "ts", *OHLCV)


def read_watchlist(spark: SparkSession, path: str, symbols: list[str], timeframes: list[str]) -> DataFrame:
    """Candles of every symbol in every timeframe, each named once in the order
    of first mention: ``symbol, tf, place`` and the candle, in one scan.  A pair
    without candles gives one row with a null ``ts``."""
    symbols, timeframes = list(dict.fromkeys(symbols)), list(dict.fromkeys(timeframes))
    pairs = spark.createDataFrame([(s, t, i * len(timeframes) + j) for i, s in enumerate(symbols) for j, t in enumerate(timeframes)], "symbol string, tf string, place int")
    # the pairs are configuration
    return F.broadcast(pairs).join(read_candles(spark, path, symbols, timeframes), ["symbol", "tf"], "left").select("symbol", "tf", "place", "ts", *OHLCV)


def read_through(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """What ``path`` holds; made and written first if it is missing or ``force``."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if force or not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").csv(path)


def translated(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` with ``venue_symbol`` for its ``symbol``; a symbol without a
    translation fails the query when it is read."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    found = F.try_element_at(table, F.col("symbol"))
    return df.withColumn("venue_symbol", F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no translation for "), F.col("symbol")))))
