"""Swing pivots, market structure and divergences, each known only once confirmed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .asof import asof, positions
from .indicators import KEY, series


def pivots(df: DataFrame, bars: int = 3) -> DataFrame:
    """Adds ``pivot_high`` and ``pivot_low``: the close is strictly beyond the
    ``bars`` closes on either side, all of which exist."""
    df = df if "pos" in df.columns else positions(df)
    left, right = series().rowsBetween(-bars, -1), series().rowsBetween(1, bars)
    whole = (F.count("close").over(left) == bars) & (F.count("close").over(right) == bars)
    high = whole & (F.col("close") > F.max("close").over(left)) & (F.col("close") > F.max("close").over(right))
    low = whole & (F.col("close") < F.min("close").over(left)) & (F.col("close") < F.min("close").over(right))
    return df.withColumns({"pivot_high": F.coalesce(high, F.lit(False)), "pivot_low": F.coalesce(low, F.lit(False))})


def last_pivots(df: DataFrame, bars: int = 3) -> DataFrame:
    """Adds the last and second-last confirmed pivot closes ``high_1, high_2,
    low_1, low_2``; a pivot is known ``bars`` bars after it."""
    df = pivots(df, bars)
    for side in ("high", "low"):
        own = F.when(F.col(f"pivot_{side}"), F.col("close"))
        before = F.last(own, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumns({f"__{side}": own, f"__{side}_before": F.when(F.col(f"pivot_{side}"), F.struct(before.alias("v")))})
    known = series().rowsBetween(Window.unboundedPreceding, -bars)
    for side in ("high", "low"):
        df = df.withColumns({f"{side}_1": F.last(f"__{side}", ignorenulls=True).over(known), f"{side}_2": F.last(f"__{side}_before", ignorenulls=True).over(known)["v"]})
    return df.drop("__high", "__low", "__high_before", "__low_before")


def market_structure(df: DataFrame, bars: int = 3) -> DataFrame:
    """Adds ``regime`` (bullish: both last pivots rose; bearish: both fell; else
    undefined), ``swing_high``, ``swing_low`` and ``break``: +1 above the last
    high, -1 below the last low, which wins."""
    df = last_pivots(df, bars)
    up = (F.col("high_1") > F.col("high_2")) & (F.col("low_1") > F.col("low_2"))
    down = (F.col("high_1") < F.col("high_2")) & (F.col("low_1") < F.col("low_2"))
    return df.withColumns({
        "regime": F.when(up, "bullish").when(down, "bearish").otherwise("undefined"), "swing_high": F.col("high_1"), "swing_low": F.col("low_1"),
        "break": F.when(F.col("close") < F.col("low_1"), -1).when(F.col("close") > F.col("high_1"), 1).otherwise(0).cast("long"),
    }).drop("high_1", "high_2", "low_1", "low_2", "pivot_high", "pivot_low")


def aligned_structure(df: DataFrame, coarse: DataFrame, seconds: int, bars: int = 3) -> DataFrame:
    """``df`` with the ``regime`` of the coarse bar that has closed last."""
    regimes = market_structure(coarse, bars).select(KEY, "ts", "regime")
    found = asof(df, regimes, ["regime"], delay=seconds)
    return found.withColumn("regime", F.coalesce("regime", F.lit("undefined")))


def divergences(df: DataFrame, momentum: str, bars: int = 3, most: int = 40) -> DataFrame:
    """Adds ``divergence`` ('' for none) and ``strength``.

    Bullish: a lower pivot low with higher momentum than the low before, at most
    ``most`` bars earlier; bearish mirrored.  Declared ``bars`` after the second
    pivot; a bearish one wins over a bullish one of the same bar.
    """
    df = pivots(df, bars)
    out = {}
    for side, name in (("low", "bullish"), ("high", "bearish")):
        here = F.when(F.col(f"pivot_{side}"), F.struct("pos", "close", F.col(momentum).alias("m")))
        past = F.last(here, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn(f"__{side}", past)
        p = F.col(f"__{side}")
        worse = F.col("close") < p["close"] if side == "low" else F.col("close") > p["close"]
        better = F.col(momentum) > p["m"] if side == "low" else F.col(momentum) < p["m"]
        found = F.col(f"pivot_{side}") & (F.col("pos") - p["pos"] <= most) & worse & better
        size = F.abs(p["m"]) + F.abs(F.col(momentum))
        strength = F.coalesce(F.try_divide(F.abs(F.col(momentum) - p["m"]), F.nullif(size, F.lit(0.0))), F.lit(0.0))
        out[side] = F.when(found, F.struct(F.lit(name).alias("name"), strength.alias("strength")))
    df = df.withColumn("__found", F.coalesce(out["high"], out["low"])).withColumn("__known", F.lag("__found", bars).over(series()))
    return df.withColumns({"divergence": F.coalesce("__known.name", F.lit("")), "strength": F.coalesce("__known.strength", F.lit(0.0))}).drop(
        "__low", "__high", "__found", "__known", "pivot_high", "pivot_low"
    )


def standing_divergence(df: DataFrame, bars: int = 12) -> DataFrame:
    """Adds ``divergence_alive``: the last divergence for ``bars`` bars from its
    declaration, '' after."""
    df = df if "pos" in df.columns else positions(df)
    seen = F.last(F.when(F.col("divergence") != "", F.struct("pos", "divergence")), ignorenulls=True).over(series())
    return df.withColumn("__seen", seen).withColumn(
        "divergence_alive", F.when(F.col("pos") - F.col("__seen.pos") < bars, F.col("__seen.divergence")).otherwise(F.lit(""))
    ).drop("__seen")
