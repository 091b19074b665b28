"""Joins by time: the latest known value, or the next bar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, values: list[str], delay: int = 0, strict: bool = False, key: str = "symbol", block: int = 7 * 86400) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` at or before
    each ``ts`` (``strict``: before it), null if there is none.

    A row of ``right`` counts from ``ts + delay`` seconds on.  Both sides are
    interleaved and carried forward in blocks of ``block`` seconds, with each
    block's last value carried to the later ones, so a key with very many rows
    is spread over its blocks and nothing is paired.
    """
    at = F.unix_micros("ts")
    a = left.withColumns({"__t": at, "__side": F.lit(0 if strict else 1), "__v": F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType), "__row": F.struct(*left.columns)})
    b = right.select(F.col(key), (at + F.lit(delay * 1_000_000)).alias("__t"), F.lit(1 if strict else 0).alias("__side"), F.struct(*values).alias("__v"))
    both = a.select(key, "__t", "__side", "__v", "__row").unionByName(b, allowMissingColumns=True).withColumn("__b", F.floor(F.col("__t") / F.lit(block * 1_000_000)))
    near = Window.partitionBy(key, "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    inner = both.withColumn("__last", F.last("__v", ignorenulls=True).over(near))
    ends = both.groupBy(key, "__b").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct("__t", "__side"))).alias("__end"))
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select(key, "__b", F.last("__end", ignorenulls=True).over(before).alias("__head"))
    found = inner.where("__row IS NOT NULL").join(heads, [key, "__b"]).withColumn("__got", F.coalesce("__last", "__head"))
    return found.select("__row.*", *[F.col(f"__got.{v}").alias(v) for v in values])


def next_bar(points: DataFrame, candles: DataFrame, key: str = "symbol") -> DataFrame:
    """``points`` (``symbol, ts, ...``) with ``pos``, the number of candles
    before ``ts``: the place of the first bar at or after it.  A point beyond
    the last bar gets the number of bars."""
    counted = positions(candles, key).select(key, "ts", (F.col("pos") + 1).alias("pos"))
    return asof(points, counted, ["pos"], strict=True, key=key).withColumn("pos", F.coalesce("pos", F.lit(0).cast("long")))


def positions(candles: DataFrame, key: str = "symbol") -> DataFrame:
    """Adds ``pos``: each bar's place in its series, from 0."""
    return candles.withColumn("pos", (F.row_number().over(Window.partitionBy(key).orderBy("ts")) - 1).cast("long"))


def inside_bars(fine: DataFrame, coarse: DataFrame, seconds: int, key: str = "symbol") -> DataFrame:
    """Fine candles with the coarse bar (``bar_ts``) they lie in: an equi-join
    on the bar's start, not a range join."""
    from ..sources.candles import bucket

    bars = coarse.select(key, F.col("ts").alias("bar_ts"))
    return fine.withColumn("bar_ts", bucket("ts", seconds)).join(bars, [key, "bar_ts"])


def in_intervals(candles: DataFrame, intervals: DataFrame, days: int = 1, key: str = "symbol") -> DataFrame:
    """Candles joined with the intervals (``symbol, start, end, ...``, both
    ends included) they lie in.  Intervals are cut into day buckets first, so
    this too is an equi-join with a residual condition."""
    width = days * 86400
    cut = intervals.withColumn("__day", F.explode(F.sequence(F.floor(F.unix_seconds("start") / width), F.floor(F.unix_seconds("end") / width))))
    bars = candles.withColumn("__day", F.floor(F.unix_seconds("ts") / width))
    return bars.join(cut, [key, "__day"]).where(F.col("ts").between(F.col("start"), F.col("end"))).drop("__day")


def temporal_iou(a_start: str, a_end: str, b_start: str, b_end: str):
    """Shared time over spanned time of two intervals, 0 if they don't meet."""
    s = lambda c: F.unix_seconds(c).cast("double")
    shared = F.least(s(a_end), s(b_end)) - F.greatest(s(a_start), s(b_start))
    spanned = F.greatest(s(a_end), s(b_end)) - F.least(s(a_start), s(b_start))
    return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(shared, spanned), F.lit(0.0)))


def best_overlap(wanted: DataFrame, found: DataFrame, key: str = "symbol", days: int = 30) -> DataFrame:
    """Each interval of ``wanted`` (``symbol, start, end``) with the one of
    ``found`` that overlaps it most (ties: earliest), or nulls and 0.  Pairs
    meet in month buckets only."""
    width = days * 86400
    span = lambda: F.sequence(F.floor(F.unix_seconds("start") / width), F.floor(F.unix_seconds("end") / width))
    left = wanted.select(key, "start", "end")
    pairs = (
        left.withColumn("__d", F.explode(span())).join(found.withColumn("__d", F.explode(span())).select(key, "__d", F.col("start").alias("found_start"), F.col("end").alias("found_end")), [key, "__d"])
        .drop("__d").distinct().withColumn("iou", temporal_iou("start", "end", "found_start", "found_end")).where("iou > 0")
    )
    best = pairs.groupBy(key, "start", "end").agg(F.max_by(F.struct("found_start", "found_end", "iou"), F.struct("iou", -F.unix_seconds("found_start"), -F.unix_seconds("found_end"))).alias("m"))
    return left.join(best, [key, "start", "end"], "left").select(key, "start", "end", "m.found_start", "m.found_end", F.coalesce("m.iou", F.lit(0.0)).alias("iou"))
