"""Indicator series as window columns.

All functions take candles with ``symbol, ts`` and the prices they need and add
columns.  Windows run per symbol over bars, whose number is bounded by time;
raw ticks are folded to bars before.  A rolling value is null until its window
is full.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .asof import positions

KEY = "symbol"


def series(key: str = KEY) -> WindowSpec:
    return Window.partitionBy(key).orderBy("ts")


def last(n: int, key: str = KEY) -> WindowSpec:
    """The current row and the ``n - 1`` before it."""
    return series(key).rowsBetween(-(n - 1), 0)


def full(value: Column, of: str | Column, n: int, least: int | None = None, key: str = KEY) -> Column:
    """``value`` where the last ``n`` rows hold ``least`` (default all) non-null ``of``."""
    return F.when(F.count(of).over(last(n, key)) >= (n if least is None else least), value)


def sma(value: str, n: int) -> Column:
    return full(F.avg(value).over(last(n)), value, n)


def true_range() -> Column:
    before = F.lag("close").over(series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(df: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    """Mean true range of ``n`` bars."""
    return df.withColumn("__tr", true_range()).withColumn(out, sma("__tr", n)).drop("__tr")


def ewm(df: DataFrame, value: str, alpha: float, out: str) -> DataFrame:
    """Exponential mean ``y = (1 - alpha) y + alpha x`` from the first non-null.

    The series is cut into blocks so long that what lies two blocks back weighs
    less than 1e-17.  Inside a block the recursion is a scaled running sum; the
    block before comes in through its last value.  All window sums: O(n), and no
    array of a whole series.  Nulls may stand at the beginning only.
    """
    keep = 1.0 - alpha
    size = math.ceil(math.log(1e-17) / math.log(keep))
    by = Window.partitionBy(KEY)
    n, k = F.col("__n"), F.col("__k")
    df = df if "pos" in df.columns else positions(df, KEY).withColumn("__own_pos", F.lit(True))
    df = df.withColumn("__n", F.when(F.col(value).isNotNull(), F.col("pos") - F.min(F.when(F.col(value).isNotNull(), F.col("pos"))).over(by)))
    df = df.withColumns({"__b": F.floor(n / size), "__k": n % size})
    term = F.when(n == 0, F.col(value)).otherwise(F.lit(alpha) * F.col(value)) * F.pow(F.lit(keep), -k)
    inner = Window.partitionBy(KEY, "__b").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__local", F.sum(term).over(inner) * F.pow(F.lit(keep), k))
    ended = F.last(F.when(k == size - 1, F.col("__local")), ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn(out, F.when(n.isNotNull(), F.col("__local") + F.pow(F.lit(keep), k + 1) * F.coalesce(ended, F.lit(0.0))))
    df = df.drop("__n", "__b", "__k", "__local")
    return df.drop("pos", "__own_pos") if "__own_pos" in df.columns else df


def regression(df: DataFrame, n: int, value: str = "close") -> DataFrame:
    """Adds ``slope``, ``r2`` and ``mean`` of a straight line through the last
    ``n`` values; ``r2`` is null where the values don't vary."""
    df = df if "pos" in df.columns else positions(df)
    w, x = last(n), F.col("pos").cast("double")
    cov, var_x, var_y = F.covar_samp(value, x).over(w), F.var_samp(x).over(w), F.var_samp(value).over(w)
    r2 = F.try_divide(cov * cov, F.nullif(var_x * var_y, F.lit(0.0)))
    return df.withColumns({"slope": full(F.try_divide(cov, var_x), value, n), "r2": full(r2, value, n), "mean": full(F.avg(value).over(w), value, n)})


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's relative strength; 100 while there is no loss."""
    step = F.col("close") - F.lag("close").over(series())
    df = df.withColumns({"__up": F.greatest(step, F.lit(0.0) * step), "__down": F.greatest(-step, F.lit(0.0) * step)})
    df = ewm(ewm(df, "__up", 1 / n, "__mu"), "__down", 1 / n, "__md")
    value = F.when(F.col("__md") > 0, 100 - 100 / (1 + F.col("__mu") / F.col("__md"))).otherwise(100.0)
    return df.withColumn("rsi", value).drop("__up", "__down", "__mu", "__md")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Adds ``macd``, its ``signal`` and their difference ``histogram``."""
    df = ewm(ewm(df, "close", 2 / (fast + 1), "__f"), "close", 2 / (slow + 1), "__s")
    df = ewm(df.withColumn("macd", F.col("__f") - F.col("__s")), "macd", 2 / (signal + 1), "signal")
    return df.withColumn("histogram", F.col("macd") - F.col("signal")).drop("__f", "__s")


def stochastic(df: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    """%K in percent, smoothed; null where the range is flat."""
    low, high = full(F.min("low").over(last(n)), "low", n), full(F.max("high").over(last(n)), "high", n)
    df = df.withColumn("__k", F.try_divide(100 * (F.col("close") - low), F.nullif(high - low, F.lit(0.0))))
    return df.withColumn("stochastic", F.col("__k") if smooth <= 1 else sma("__k", smooth)).drop("__k")


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """Adds ``di_plus``, ``di_minus`` and ``adx`` (Wilder)."""
    up, down = F.col("high") - F.lag("high").over(series()), F.lag("low").over(series()) - F.col("low")
    only = lambda a, b: F.when((a > b) & (a > 0), a).otherwise(0.0)
    df = df.withColumns({"__plus": only(up, down), "__minus": only(down, up), "__tr": true_range()})
    for name in ("plus", "minus", "tr"):
        df = ewm(df, f"__{name}", 1 / n, f"__e{name}")
    safe = F.nullif(F.col("__etr"), F.lit(0.0))
    df = df.withColumns({"di_plus": F.try_divide(100 * F.col("__eplus"), safe), "di_minus": F.try_divide(100 * F.col("__eminus"), safe)})
    total = F.nullif(F.col("di_plus") + F.col("di_minus"), F.lit(0.0))
    df = df.withColumn("__dx", F.try_divide(100 * F.abs(F.col("di_plus") - F.col("di_minus")), total))
    return ewm(df, "__dx", 1 / n, "adx").drop("__plus", "__minus", "__tr", "__eplus", "__eminus", "__etr", "__dx")


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Adds ``bb_mid``, ``bb_up``, ``bb_low``, ``bb_width`` and ``bb_pct``."""
    mid, dev = sma("close", n), full(F.stddev_samp("close").over(last(n)), "close", n)
    df = df.withColumns({"bb_mid": mid, "bb_up": mid + k * dev, "bb_low": mid - k * dev})
    span = F.col("bb_up") - F.col("bb_low")
    return df.withColumns({"bb_width": F.try_divide(span, F.nullif(F.col("bb_mid"), F.lit(0.0))), "bb_pct": F.try_divide(F.col("close") - F.col("bb_low"), F.nullif(span, F.lit(0.0)))})


def keltner(df: DataFrame, n: int = 20, k: float = 1.5) -> DataFrame:
    """Adds ``kc_mid``, ``kc_up`` and ``kc_low``: exponential mean and mean true range."""
    df = atr(ewm(df, "close", 2 / (n + 1), "kc_mid"), n, "__katr")
    return df.withColumns({"kc_up": F.col("kc_mid") + k * F.col("__katr"), "kc_low": F.col("kc_mid") - k * F.col("__katr")}).drop("__katr")


def squeeze(df: DataFrame, n: int = 20, k: float = 2.0, keltner_k: float = 1.5) -> DataFrame:
    """Adds ``squeeze`` (Bollinger inside Keltner; null while either is) and
    ``squeeze_bars``, how long the state has lasted."""
    df = keltner(bollinger(df, n, k), n, keltner_k)
    inside = F.when(F.col("bb_up").isNotNull() & F.col("kc_up").isNotNull(), (F.col("bb_up") < F.col("kc_up")) & (F.col("bb_low") > F.col("kc_low")))
    df = df.withColumn("squeeze", inside).withColumn("__on", F.coalesce("squeeze", F.lit(False)))
    change = F.coalesce(F.col("__on") != F.lag("__on").over(series()), F.lit(True)).cast("int")
    df = df.withColumn("__change", change).withColumn("__run", F.sum("__change").over(series()))
    run = F.row_number().over(Window.partitionBy(KEY, "__run").orderBy("ts"))
    return df.withColumn("squeeze_bars", run).drop("__on", "__change", "__run", "bb_mid", "bb_up", "bb_low", "bb_width", "bb_pct", "kc_mid", "kc_up", "kc_low")


def ttm_momentum(df: DataFrame, n: int = 20) -> DataFrame:
    """Adds ``ttm``: slope of the last ``n`` deviations of the close from the
    mean of channel middle and moving average; and ``ttm_phase``."""
    df = df if "pos" in df.columns else positions(df)
    middle = (full(F.max("high").over(last(n)), "high", n) + full(F.min("low").over(last(n)), "low", n)) / 2
    df = df.withColumn("__dev", F.col("close") - (middle + sma("close", n)) / 2)
    slope = F.try_divide(F.covar_samp("__dev", F.col("pos").cast("double")).over(last(n)), F.var_samp(F.col("pos").cast("double")).over(last(n)))
    df = df.withColumn("ttm", full(slope, "__dev", n)).drop("__dev")
    before = F.lag("ttm").over(series())
    rising, above = F.col("ttm") - before > 0, F.col("ttm") > 0
    phase = (
        F.when(F.col("ttm").isNull() | before.isNull(), "").when(above & rising, "bullish_strong").when(above, "bullish_weak")
        .when(rising, "bearish_weak").otherwise("bearish_strong")
    )
    return df.withColumn("ttm_phase", phase)


def impulse(df: DataFrame, bars: int = 6, atr_col: str = "atr") -> DataFrame:
    """Adds ``impulse``: how many mean true ranges the close moved in ``bars``."""
    return df.withColumn("impulse", F.try_divide(F.abs(F.col("close") - F.lag("close", bars).over(series())), F.nullif(F.col(atr_col), F.lit(0.0))))


#: Bars of a block in which order statistics slide, beside the window before it.
SLIDING = 8192


class _Sorted:
    """The values of a sliding window in order: one goes in and one out at each
    bar, at places found by bisection."""

    def __init__(self) -> None:
        self.values: list[float] = []

    def slide(self, new: float | None, gone: float | None) -> list[float]:
        if gone is not None:
            del self.values[bisect.bisect_left(self.values, gone)]
        if new is not None:
            bisect.insort(self.values, new)
        return self.values


def _sliding(df: DataFrame, value: str, n: int, least: int, read: Callable[[list[float], float | None], float | None], out: str, block: int) -> DataFrame:
    """Adds ``out``: what ``read`` finds in the ordered last ``n`` values.

    The series is cut into blocks; each gets the ``n - 1`` bars before it, of
    which one window slides over all.  A task holds block and window.  Nulls and
    NaN count for nothing.
    """
    block = max(block, n)
    df = df if "pos" in df.columns else positions(df, KEY).withColumn("__own_pos", F.lit(True))
    dealt = df.select(KEY, "pos", F.col(value).cast("double").alias("x"), F.explode(F.expr(f"sequence(pos div {block}, (pos + {n - 1}) div {block})")).alias("block"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        values = [None if math.isnan(x) else x for x in pdf["x"].to_numpy(float).tolist()]
        window, found = _Sorted(), []
        for i, x in enumerate(values):
            held = window.slide(x, values[i - n] if i >= n else None)
            found.append(read(held, x) if len(held) >= least else None)
        own = (pdf["pos"] >= key[1] * block).to_numpy()
        return pd.DataFrame({KEY: key[0], "pos": pdf["pos"][own], "__found": pd.Series(found, dtype="float64", index=pdf.index)[own]})

    found = dealt.groupBy(KEY, "block").applyInPandas(run, "symbol string, pos long, __found double")
    df = df.join(found, [KEY, "pos"]).withColumnRenamed("__found", out)
    return df.drop("pos", "__own_pos") if "__own_pos" in df.columns else df


def rolling_rank(df: DataFrame, value: str, n: int = 120, least: int = 30, out: str = "pct_rank", block: int = SLIDING) -> DataFrame:
    """Share of the last ``n`` values that are at most this one (ties count half)."""

    def read(held: list[float], x: float | None) -> float | None:
        if x is None:
            return None
        below, upto = bisect.bisect_left(held, x), bisect.bisect_right(held, x)
        return (below + (upto - below + 1) / 2) / len(held)

    return _sliding(df, value, n, least, read, out, block)


def rolling_quantile(df: DataFrame, value: str, q: float = 0.95, n: int = 500, least: int = 50, out: str = "quantile", block: int = SLIDING) -> DataFrame:
    """Linear-interpolated quantile of the last ``n`` values."""

    def read(held: list[float], x: float | None) -> float | None:
        at = (len(held) - 1) * q
        low = math.floor(at)
        a, b = held[low], held[min(low + 1, len(held) - 1)]
        return a + (b - a) * (at - low)

    return _sliding(df, value, n, max(1, least), read, out, block)


def display_scaled(df: DataFrame, value: str, out: str = "scaled") -> DataFrame:
    """``value`` in percent of its rolling 0.95 quantile of size, within 100."""
    df = rolling_quantile(df.withColumn("__abs", F.abs(value)), "__abs", out="__q")
    scaled = F.try_divide(100 * F.col(value), F.nullif(F.col("__q"), F.lit(0.0)))
    return df.withColumn(out, F.when(scaled.isNotNull(), F.greatest(F.lit(-100.0), F.least(F.lit(100.0), scaled)))).drop("__abs", "__q")


def funding_features(df: DataFrame, n: int = 180, least: int | None = None, sums: int = 6) -> DataFrame:
    """Adds ``funding_z`` (null where the rate doesn't vary) and ``funding_sum``."""
    least = n // 2 if least is None else least
    mean, dev = F.avg("funding").over(last(n)), F.stddev_samp("funding").over(last(n))
    z = full(F.try_divide(F.col("funding") - mean, F.nullif(dev, F.lit(0.0))), "funding", n, least)
    return df.withColumns({"funding_z": z, "funding_sum": full(F.sum("funding").over(last(sums)), "funding", sums)})


def excursions(df: DataFrame, bars: int = 24, long: bool = True, atr_col: str = "atr") -> DataFrame:
    """From this bar's close over the next ``bars`` bars (this one the first):
    best and worst move in mean true ranges, and efficiency."""
    ahead = series().rowsBetween(0, bars - 1)
    high, low = F.max("high").over(ahead), F.min("low").over(ahead)
    whole = F.count("*").over(ahead) == bars
    best, worst = (high - F.col("close"), F.col("close") - low) if long else (F.col("close") - low, high - F.col("close"))
    safe = F.nullif(F.col(atr_col), F.lit(0.0))
    df = df.withColumns({"mfe": F.when(whole, F.try_divide(best, safe)), "mae": F.when(whole, F.try_divide(worst, safe))})
    return df.withColumn("efficiency", F.col("mfe") / F.greatest(F.col("mfe") + F.greatest(F.col("mae"), F.lit(0.0)), F.lit(1e-9)))
