"""Price gaps (three-bar imbalances) and how they fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import require_columns
from ..sources.store import written
from . import passage
from .asof import next_bar, positions
from .indicators import KEY, series

#: Bars of a block by which a gap meets the bars of its life.
BLOCK = 256


def detect(candles: DataFrame, seconds: int) -> DataFrame:
    """``symbol, kind, top, bottom, formed_at, confirmed_at, gap_id``: bullish
    where the third low is above the first high, bearish mirrored.  Known when
    the third bar, ``seconds`` long, has closed."""
    require_columns(candles, KEY, "ts", "high", "low")
    df = candles.withColumns({"h1": F.lag("high", 2).over(series()), "l1": F.lag("low", 2).over(series())})
    gap = F.when(F.col("low") > F.col("h1"), F.struct(F.lit("bullish").alias("kind"), F.col("low").alias("top"), F.col("h1").alias("bottom"))).when(
        F.col("high") < F.col("l1"), F.struct(F.lit("bearish").alias("kind"), F.col("l1").alias("top"), F.col("high").alias("bottom"))
    )
    found = df.withColumn("gap", gap).where("gap IS NOT NULL")
    known = F.timestamp_seconds(F.unix_seconds("ts") + seconds)
    return found.select(KEY, "gap.*", F.col("ts").alias("formed_at"), known.alias("confirmed_at"), F.concat_ws("/", F.col(KEY), F.unix_seconds("ts").cast("string")).alias("gap_id"))


def deaths(gaps: DataFrame, bars: DataFrame) -> DataFrame:
    """``gaps`` with ``since``, the first bar (``bars`` has ``pos``) at which the
    gap is known, and ``dead_pos``, the first from there on whose wick reaches
    its far side, null if none does.  Looked up in a tree of extremes: two nodes
    a level for each gap, whatever lies between."""
    counted = next_bar(gaps.withColumn("ts", F.col("confirmed_at")), bars).withColumnRenamed("pos", "since").drop("ts")
    tree = passage.build(bars, {"low": "min", "high": "max"})
    fills = lambda k, leaf: F.when(F.col("kind") == "bullish", k["low"] <= F.col("bottom")).otherwise(k["high"] >= F.col("top"))
    return passage.first_passage(counted, tree, F.col("since"), fills, "dead_pos")


def evolution(gaps: DataFrame, candles: DataFrame) -> DataFrame:
    """Gap by gap the bars from its confirmation to its death: ``gap_id, ts,
    edge, alive``.  Wicks erode the edge; the gap dies in the bar that takes
    it to the far side, which is its last row here.

    The death is looked up first, so a gap meets its own bars only, by blocks.
    """
    bars = written(positions(candles.select(KEY, "ts", "high", "low")))
    lives = deaths(written(gaps), bars)
    ends = bars.groupBy(KEY).agg(F.max("pos").alias("last"))
    lives = lives.join(ends, KEY).withColumn("until", F.coalesce("dead_pos", "last")).where("since <= until")
    met = lives.withColumn("block", F.explode(F.expr(f"sequence(since div {BLOCK}, until div {BLOCK})")))
    later = met.join(bars.withColumn("block", F.expr(f"pos div {BLOCK}")), [KEY, "block"]).where(F.col("pos").between(F.col("since"), F.col("until")))
    path = Window.partitionBy("gap_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    bull = F.col("kind") == "bullish"
    worn = F.when(bull, F.min("low").over(path)).otherwise(F.max("high").over(path))
    df = later.withColumn("edge", F.least(F.col("top"), F.greatest(F.col("bottom"), worn)))
    return df.select(KEY, "gap_id", "kind", "top", "bottom", "confirmed_at", "ts", "edge", (F.col("dead_pos").isNull() | (F.col("pos") < F.col("dead_pos"))).alias("alive"))


def target_points(gaps: DataFrame, candles: DataFrame) -> DataFrame:
    """``symbol, gap_id, ts, edge, mid`` of every bar at which a gap is alive;
    ``mid`` is half-way from the edge to the fixed side."""
    fixed = F.when(F.col("kind") == "bullish", F.col("bottom")).otherwise(F.col("top"))
    return evolution(gaps, candles).where("alive").select(KEY, "gap_id", "ts", "edge", ((F.col("edge") + fixed) / 2).alias("mid"))


def alive_at(gaps: DataFrame, candles: DataFrame, instant) -> DataFrame:
    """The gaps known and not filled at ``instant`` (a column), cut to what is
    left of them."""
    known = gaps.where(F.col("confirmed_at") <= instant)
    path = evolution(known, candles.where(F.col("ts") <= instant))
    now = path.groupBy("gap_id").agg(F.max_by("edge", "ts").alias("edge"), F.bool_and("alive").alias("alive"))
    left = known.join(now, "gap_id", "left").where("alive IS NULL OR alive")
    bull = F.col("kind") == "bullish"
    return left.withColumns({
        "top": F.when(bull, F.coalesce("edge", "top")).otherwise(F.col("top")), "bottom": F.when(~bull, F.coalesce("edge", "bottom")).otherwise(F.col("bottom")),
    }).select(*gaps.columns)


def staircase(gaps: DataFrame, candles: DataFrame) -> DataFrame:
    """Only the rows of ``evolution`` at which an alive gap's edge changes."""
    path = evolution(gaps, candles).where("alive")
    before = F.lag("edge").over(Window.partitionBy("gap_id").orderBy("ts"))
    return path.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("edge") != F.col("__before"))).select(KEY, "gap_id", "ts", "edge")
