"""Candle and funding audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import OHLCV, require_columns
from ..sources.store import write_candles


def duplicates(candles: DataFrame) -> DataFrame:
    """``symbol, duplicates``: rows beyond the first of each time."""
    per_time = candles.groupBy("symbol", "ts").agg(F.count("*").alias("n"))
    return per_time.groupBy("symbol").agg(F.sum(F.col("n") - 1).alias("duplicates"))


def impossible(candles: DataFrame) -> DataFrame:
    """Rows with high below low, negative volume or a missing price."""
    require_columns(candles, *OHLCV)
    missing = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    return candles.where(missing | F.coalesce(F.col("high") < F.col("low"), F.lit(False)) | F.coalesce(F.col("volume") < 0, F.lit(False)))


def gaps(candles: DataFrame, seconds: int) -> DataFrame:
    """``symbol, ts`` of every bar missing between a symbol's first and last.

    Found between neighbouring bars, so nothing is expanded but the holes.
    """
    after = F.lead("s").over(Window.partitionBy("symbol").orderBy("s"))
    times = candles.select("symbol", F.unix_seconds("ts").alias("s")).distinct().withColumn("next", after)
    holes = times.where(F.col("next") > F.col("s") + seconds)
    missing = holes.select("symbol", F.explode(F.sequence(F.col("s") + seconds, F.col("next") - 1, F.lit(seconds).cast("long"))).alias("s"))
    return missing.select("symbol", F.timestamp_seconds("s").alias("ts"))


def report(candles: DataFrame, seconds: int) -> DataFrame:
    """One row per symbol: rows, first and last time, bars expected, missing,
    coverage in percent of the expected bars, duplicates, impossible rows."""
    require_columns(candles, "symbol", "ts", *OHLCV)
    per_time = candles.groupBy("symbol", "ts").agg(F.count("*").alias("n"), F.sum(_faulty().cast("int")).alias("bad"))
    s = F.unix_seconds("ts")
    rows = per_time.groupBy("symbol").agg(
        F.sum("n").alias("n_rows"), F.min(s).alias("first_s"), F.max(s).alias("last_s"), F.count("*").alias("present"), F.sum("bad").alias("n_impossible")
    )
    return _reported(rows, seconds)


def _faulty() -> Column:
    return (
        F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
        | F.coalesce(F.col("high") < F.col("low"), F.lit(False)) | F.coalesce(F.col("volume") < 0, F.lit(False))
    )


def _reported(rows: DataFrame, seconds: int) -> DataFrame:
    expected = F.expr(f"(last_s - first_s) div {seconds} + 1")
    return rows.withColumn("expected", expected).select(
        "symbol", "n_rows", "first_s", "last_s", "expected", (F.col("expected") - F.col("present")).alias("n_missing"),
        (F.lit(100.0) * F.col("n_rows") / F.col("expected")).alias("coverage_pct"), (F.col("n_rows") - F.col("present")).alias("n_duplicates"), "n_impossible",
    )


def land_audited(candles: DataFrame, path: str, timeframe: str, symbols: list[str], seconds: int) -> DataFrame:
    """Writes ``candles`` to the table at ``path``, the first row of each symbol
    and time by its values, and gives the ``report`` of what came in.

    The figures are observed on the rows as they pass to the files, so there is
    one scan and no second plan.  Observed figures can't be grouped: each symbol
    of the watchlist has its own five, and a symbol outside it raises
    ``ValueError``, as does a table without rows.
    """
    require_columns(candles, "symbol", "ts", *OHLCV)
    spark, own = candles.sparkSession, list(dict.fromkeys(symbols))
    first = Window.partitionBy("symbol", "ts").orderBy(*OHLCV)
    s, of = F.unix_seconds("ts"), lambda name, value: F.when(F.col("symbol") == name, value)
    figures = [F.count("*").alias("all")]
    for k, name in enumerate(own):
        figures += [
            F.count(of(name, F.lit(1))).alias(f"n_{k}"), F.min(of(name, s)).alias(f"first_{k}"), F.max(of(name, s)).alias(f"last_{k}"),
            F.count(of(name, F.when(F.col("__n") == 1, 1))).alias(f"present_{k}"), F.count(of(name, F.when(_faulty(), 1))).alias(f"bad_{k}"),
        ]
    audit = Observation("audit")
    watched = candles.withColumn("__n", F.row_number().over(first)).observe(audit, *figures)
    write_candles(watched.where("__n = 1").drop("__n"), path, timeframe)
    got = audit.get
    rows = [(name, *(got[f"{what}_{k}"] for what in ("n", "first", "last", "present", "bad"))) for k, name in enumerate(own) if got[f"n_{k}"]]
    if not rows or sum(r[1] for r in rows) != got["all"]:
        raise ValueError(f"{got['all'] - sum(r[1] for r in rows)} of {got['all']} rows are of symbols outside the watchlist, or there are none")
    return _reported(spark.createDataFrame(rows, "symbol string, n_rows long, first_s long, last_s long, present long, n_impossible long"), seconds)


def funding_faults(funding: DataFrame, most: float = 0.1) -> DataFrame:
    """Per symbol: rows, duplicates, nulls and rates beyond ``most``."""
    per_time = funding.groupBy("symbol", "ts").agg(
        F.count("*").alias("n"), F.sum(F.col("funding").isNull().cast("int")).alias("nulls"), F.sum(F.coalesce(F.abs("funding") > most, F.lit(False)).cast("int")).alias("wild")
    )
    return per_time.groupBy("symbol").agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_duplicates"), F.sum("nulls").alias("n_nulls"), F.sum("wild").alias("n_extreme"))


def require_valid_funding(funding: DataFrame, most: float = 0.1) -> DataFrame:
    """``funding`` itself; raises ``ValueError`` if it is empty or has faults."""
    found = funding_faults(funding, most).where("n_duplicates + n_nulls + n_extreme > 0").take(5)
    if found:
        raise ValueError(f"funding has faults: {found}")
    if funding.isEmpty():
        raise ValueError("funding is empty")
    return funding
