"""Registered queries, one per operator or family, and their oracle SQL.

Names begin with the operator's id.  Prices are rounded to 6 places and times
given as epoch seconds, so results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BacktestConfig, ProfileConfig, RangeConfig
from ..functions import signals as sig
from ..operators import asof, backtest, gaps, indicators, metrics, profile, quality, ranges, structure
from ..sources import candles as src
from ..sources import store
from . import views as v
from .views import HOUR, SQL_BARS, SQL_RATES, SQL_TRADES, SQL_WALK_TICKS, rounded, seconds, sql_walk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WEEK = 7 * 86400


def query(name: str, sql: str | None = None):
    """Registers a query, with its oracle if SQL can say it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _shown(df: DataFrame, *columns: str, times: tuple[str, ...] = ("ts",)) -> DataFrame:
    return rounded(seconds(df.select("symbol", *times, *columns), *times))


def _bars(*ctes: str) -> str:
    return "WITH " + ", ".join([SQL_BARS, *ctes]) + " "


def _walk(*ctes: str, fine: bool = False) -> str:
    return "WITH " + ", ".join([SQL_WALK_TICKS, sql_walk(), *([sql_walk("15 MINUTE", "fine")] if fine else []), *ctes]) + " "


W = "PARTITION BY symbol ORDER BY ts"


def _full(expr: str, of: str, n: int, frame: str | None = None) -> str:
    frame = frame or f"{W} ROWS {n - 1} PRECEDING"
    return f"CASE WHEN count({of}) OVER ({frame}) >= {n} THEN {expr} OVER ({frame}) END"


def _ewm(value: str, alpha: str) -> str:
    """Exponential mean over the non-null past, as a list fold."""
    seen = f"list({value}) FILTER ({value} IS NOT NULL) OVER ({W} ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN len({seen}) > 0 THEN list_reduce({seen}, lambda y, x: (1 - {alpha}) * y + {alpha} * x) END"


TR = f"greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W})))"
OUT = "symbol, epoch(ts)::BIGINT AS ts_s"


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


# sources


@query("s13_resample_4h", _bars() + """SELECT symbol, epoch(time_bucket(INTERVAL 4 HOUR, ts))::BIGINT AS ts_s, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY ts) AS close, sum(volume) AS volume FROM bars GROUP BY ALL""")
def s13_resample(spark, d):
    return _shown(src.resample(v.bars(spark, d), 4 * HOUR), "open", "high", "low", "close", "volume")


@query("s13_integer_walk", _walk() + "SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM walk")
def s13_walk(spark, d):
    return _shown(v.walk(spark, d), "open", "high", "low", "close", "volume")


@query("s05_landed_candles", _bars("""raw AS (SELECT *, 1 AS arrival FROM bars UNION ALL SELECT symbol, ts, open + 1, high + 1, low + 1, close + 1, volume, 2 FROM bars WHERE volume > 3),
  last AS (SELECT max(ts) AS now FROM bars)""") + """SELECT symbol, epoch(ts)::BIGINT AS ts_s, open, high, low, close, volume FROM raw
  WHERE ts + INTERVAL 1 HOUR <= (SELECT now FROM last) QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY arrival) = 1""")
def s05_landed(spark, d):
    bars = v.bars(spark, d)
    again = bars.where("volume > 3").withColumns({c: F.col(c) + 1 for c in ("open", "high", "low", "close")})
    raw = bars.withColumn("arrival", F.lit(1)).unionByName(again.withColumn("arrival", F.lit(2)))
    now = F.broadcast(bars.agg(F.max("ts").alias("now")))  # one row
    return _shown(src.landed(raw.crossJoin(now), HOUR, F.col("now")), "open", "high", "low", "close", "volume")


def _landing(spark: SparkSession, d: str) -> str:
    """Two downloads as pages of 100: the bars, and some of them again with
    other prices."""
    from ..sources import paged

    path, bars = store.shared_path(spark, "pages"), v.bars(spark, d)
    again = bars.where("volume > 3").withColumns({c: F.col(c) + 1 for c in ("open", "high", "low", "close")})
    for run, df in enumerate((bars, again)):
        paged.land_pages(df, path, 100, run)
    return path


@query("s05_paged_download", ORACLE_SQL["s05_landed_candles"])
def s05_paged(spark, d):
    from ..sources import paged

    raw = paged.read_pages(spark, _landing(spark, d), 100)
    now = F.broadcast(raw.where("run = 0").agg(F.max("ts").alias("now")))  # one row
    return _shown(src.landed(raw.crossJoin(now), HOUR, F.col("now")), "open", "high", "low", "close", "volume")


@query("st05_streamed_pages", ORACLE_SQL["s05_landed_candles"])
def st05(spark, d):
    from ..sources import paged
    from ..streaming import ordered

    came = ordered.run(spark, paged.read_pages(spark, _landing(spark, d), 100, stream=True, pages=1_000_000).drop("arrival")).withColumn("arrival", F.struct("run", "page", "place"))
    now = F.broadcast(came.where("run = 0").agg(F.max("ts").alias("now")))  # one row
    return _shown(src.landed(came.crossJoin(now), HOUR, F.col("now")), "open", "high", "low", "close", "volume")


@query("s06_partitioned_store", _bars() + "SELECT symbol, '1h' AS tf, epoch(ts)::BIGINT AS ts_s, open, close FROM bars WHERE symbol IN ('click', 'error', 'view')")
def s06_store(spark, d):
    path = store.shared_path(spark, "store")
    store.write_candles(v.bars(spark, d), path, "1h")
    return seconds(store.read_candles(spark, path, ["click", "error", "view"], ["1h"]).select("symbol", "tf", "ts", "open", "close"), "ts")


@query("s09_csv_round_trip", _bars() + "SELECT symbol, epoch(ts)::BIGINT AS ts_s, open, high, low, close, volume FROM bars")
def s09_csv(spark, d):
    path = store.shared_path(spark, "csv")
    store.write_csv(v.bars(spark, d), path)
    return _shown(store.read_csv(spark, path, "symbol string, ts timestamp, open double, high double, low double, close double, volume double"), "open", "high", "low", "close", "volume")


@query("s07_watchlist", _bars("pairs AS (SELECT * FROM (VALUES ('view', '1h', 0), ('view', '4h', 1), ('click', '1h', 2), ('click', '4h', 3), ('none', '1h', 4), ('none', '4h', 5)) p(symbol, tf, place))", SQL_BARS.replace("1 HOUR", "4 HOUR").replace("bars AS", "b4 AS"),
    "every_bar AS (SELECT symbol, '1h' AS tf, close FROM bars UNION ALL SELECT symbol, '4h', close FROM b4)") + "SELECT symbol, tf, CAST(place AS INTEGER) AS place, count(close) AS n, round(sum(close), 6) AS closes FROM pairs LEFT JOIN every_bar USING (symbol, tf) GROUP BY ALL")
def s07_watchlist(spark, d):
    path = store.shared_path(spark, "watchlist")
    store.write_candles(v.bars(spark, d), path, "1h")
    store.write_candles(v.bars(spark, d, 4 * HOUR), path, "4h")
    listed = store.read_watchlist(spark, path, ["view", "click", "view", "none"], ["1h", "4h", "1h"])
    return rounded(listed.groupBy("symbol", "tf", "place").agg(F.count("ts").alias("n"), F.sum("close").alias("closes")))


@query("s08_funding_read_through", "WITH " + SQL_RATES + " SELECT symbol, epoch_us(ts) AS ts_us, round(arg_min(funding, funding), 6) AS funding FROM rates GROUP BY symbol, ts")
def s08_funding(spark, d):
    path = store.shared_path(spark, "funding")
    raw = v.rates(spark, d)
    make = lambda: src.landed_rates(raw.withColumn("arrival", F.col("funding")).unionByName(raw.withColumns({"arrival": F.lit(9.0), "funding": F.lit(0.5)})))
    store.read_through(spark, path, make)
    return rounded(store.read_through(spark, path, make).select("symbol", F.unix_micros("ts").alias("ts_us"), "funding"))


@query("j15_symbol_translation", _bars() + "SELECT symbol, 'venue:' || symbol AS venue_symbol, count(*) AS n FROM bars GROUP BY ALL")
def j15_translation(spark, d):
    bars = v.bars(spark, d)
    names = {s: f"venue:{s}" for s in ("cart", "click", "error", "purchase", "view", "login", "logout", "search", "signup")}  # configuration
    return store.translated(bars, names).groupBy("symbol", "venue_symbol").agg(F.count("*").alias("n"))


# audits

_DIRTY_SQL = """dirty AS (SELECT symbol, ts, open, CASE WHEN volume % 5 = 0 THEN low - 1 ELSE high END AS high, low, CASE WHEN volume % 7 = 0 THEN NULL ELSE close END AS close, volume FROM bars
  UNION ALL SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE volume % 3 = 0)"""
_BAD_SQL = "(open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR high < low OR volume < 0)"


def _dirty(spark, d):
    bars = v.bars(spark, d)
    spoiled = bars.withColumns({"high": F.when(F.col("volume") % 5 == 0, F.col("low") - 1).otherwise(F.col("high")), "close": F.when(F.col("volume") % 7 == 0, F.lit(None)).otherwise(F.col("close"))})
    return spoiled.unionByName(bars.where("volume % 3 = 0"))


@query("q01_duplicates", _bars(_DIRTY_SQL) + "SELECT symbol, CAST(count(*) - count(DISTINCT ts) AS BIGINT) AS duplicates FROM dirty GROUP BY symbol")
def q01(spark, d):
    return quality.duplicates(_dirty(spark, d))


@query("q02_impossible_values", _bars(_DIRTY_SQL) + f"SELECT {OUT}, open, high, low, close, volume FROM dirty WHERE {_BAD_SQL}")
def q02(spark, d):
    return seconds(quality.impossible(_dirty(spark, d)).select("symbol", "ts", "open", "high", "low", "close", "volume"), "ts")


@query("q03_gaps", _bars("lim AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY symbol)", "grid AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM lim)") + f"SELECT {OUT} FROM grid ANTI JOIN bars USING (symbol, ts)")
def q03(spark, d):
    return seconds(quality.gaps(v.bars(spark, d), HOUR), "ts")


@query("q04_quality_report", _bars(_DIRTY_SQL) + f"""SELECT symbol, count(*) AS n_rows, epoch(min(ts))::BIGINT AS first_s, epoch(max(ts))::BIGINT AS last_s,
  (epoch(max(ts)) - epoch(min(ts)))::BIGINT // 3600 + 1 AS expected, (epoch(max(ts)) - epoch(min(ts)))::BIGINT // 3600 + 1 - count(DISTINCT ts) AS n_missing,
  round(100.0 * count(*) / ((epoch(max(ts)) - epoch(min(ts)))::BIGINT // 3600 + 1), 6) AS coverage_pct, count(*) - count(DISTINCT ts) AS n_duplicates,
  CAST(sum(CASE WHEN {_BAD_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS n_impossible FROM dirty GROUP BY symbol""")
def q04(spark, d):
    return rounded(quality.report(_dirty(spark, d), HOUR))


@query("q04_report_while_writing", ORACLE_SQL["q04_quality_report"])
def q04_observed(spark, d):
    dirty = _dirty(spark, d)
    symbols = [r.symbol for r in v.table(spark, d, "events").select(F.col("event_type").alias("symbol")).distinct().collect()]  # the watchlist
    return rounded(quality.land_audited(dirty, store.shared_path(spark, "audited"), "1h", symbols, HOUR))


@query("q05_funding_faults", "WITH " + SQL_RATES + """, bad AS (SELECT symbol, ts, CASE WHEN funding > 0.02 THEN funding * 10 WHEN funding < -0.0045 THEN NULL ELSE funding END AS funding FROM rates)
  SELECT symbol, count(*) AS n_rows, count(*) - count(DISTINCT ts) AS n_duplicates, CAST(sum(CASE WHEN funding IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_nulls,
  CAST(sum(CASE WHEN abs(funding) > 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS n_extreme FROM bad GROUP BY symbol""")
def q05(spark, d):
    bad = v.rates(spark, d).withColumn("funding", F.when(F.col("funding") > 0.02, F.col("funding") * 10).when(F.col("funding") < -0.0045, F.lit(None)).otherwise(F.col("funding")))
    return quality.funding_faults(bad)


# joins by time


@query("j02_asof_backward", _walk(SQL_RATES) + "SELECT w.symbol, epoch(w.ts)::BIGINT AS ts_s, round(r.funding, 6) AS funding FROM walk w ASOF LEFT JOIN rates r ON w.symbol = r.symbol AND w.ts >= r.ts")
def j02(spark, d):
    return _shown(asof.asof(v.walk(spark, d), v.rates(spark, d), ["funding"]), "funding")


@query("j02_asof_strict", _walk(SQL_RATES) + "SELECT w.symbol, epoch(w.ts)::BIGINT AS ts_s, round(r.funding, 6) AS funding FROM walk w ASOF LEFT JOIN rates r ON w.symbol = r.symbol AND w.ts > r.ts")
def j04(spark, d):
    return _shown(asof.asof(v.walk(spark, d), v.rates(spark, d), ["funding"], strict=True), "funding")


@query("j05_first_bar_at_or_after", _walk(SQL_RATES) + "SELECT symbol, floor(epoch(ts))::BIGINT AS ts_s, (SELECT count(*) FROM walk w WHERE w.ts < r.ts) AS pos FROM rates r")
def j05(spark, d):
    return _shown(asof.next_bar(v.rates(spark, d), v.walk(spark, d)), "pos")


@query("j06_bars_inside_bars", _walk(fine=True) + "SELECT f.symbol, epoch(f.ts)::BIGINT AS ts_s, epoch(w.ts)::BIGINT AS bar_ts_s, round(f.close, 6) AS close FROM fine f JOIN walk w ON w.ts = time_bucket(INTERVAL 1 HOUR, f.ts)")
def j06(spark, d):
    return _shown(asof.inside_bars(v.walk(spark, d, 900), v.walk(spark, d), HOUR), "close", times=("ts", "bar_ts"))


_SPANS_SQL = """spans AS (SELECT 'ALL' AS symbol, CAST(i AS INTEGER) AS range_id, lo + to_hours(i * 100) AS "start", lo + to_hours(i * 100 + 150) AS "end"
  FROM (SELECT lo, unnest(generate_series(0, (epoch(hi) - epoch(lo))::BIGINT // 360000)) AS i FROM (SELECT min(ts) AS lo, max(ts) AS hi FROM walk)))"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping spans of 150 hours, one every 100, from the first bar to the last."""
    ends = v.walk(spark, d).groupBy("symbol").agg(F.unix_seconds(F.min("ts")).alias("lo"), F.unix_seconds(F.max("ts")).alias("hi"))
    rows = ends.select("symbol", "lo", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / 360_000))).alias("i"))
    at = lambda hours: F.timestamp_seconds(F.col("lo") + F.col("i") * 360_000 + hours * HOUR)
    return rows.select("symbol", F.col("i").cast("int").alias("range_id"), at(0).alias("start"), at(150).alias("end"))


@query("j07_range_candles", _walk(_SPANS_SQL) + 'SELECT range_id, count(*) AS n, round(max(high), 6) AS price_max, round(min(low), 6) AS price_min FROM spans s JOIN walk w ON w.ts BETWEEN s."start" AND s."end" GROUP BY range_id')
def j07(spark, d):
    inside = asof.in_intervals(v.walk(spark, d), _spans(spark, d))
    return rounded(inside.groupBy("range_id").agg(F.count("*").alias("n"), F.max("high").alias("price_max"), F.min("low").alias("price_min")))


@query("j10_best_overlap", _walk(_SPANS_SQL) + """, f AS (SELECT "start" + to_hours(30 + range_id % 7) AS fs, "end" + INTERVAL 20 HOUR AS fe FROM spans),
  p AS (SELECT range_id, epoch("start")::BIGINT AS start_s, epoch(fs)::BIGINT AS found_start_s,
    greatest(0, (epoch(least("end", fe)) - epoch(greatest("start", fs))) / (epoch(greatest("end", fe)) - epoch(least("start", fs)))) AS iou FROM spans, f)
  SELECT 'ALL' AS symbol, start_s, CASE WHEN max(iou) > 0 THEN arg_max(found_start_s, (iou, -found_start_s)) END AS found_start_s, round(max(iou), 6) AS iou FROM p GROUP BY range_id, start_s""")
def j10(spark, d):
    spans = _spans(spark, d)
    hours = lambda c, h: F.timestamp_seconds(F.unix_seconds(c) + h * HOUR)
    found = spans.select("symbol", hours("start", F.lit(30) + F.col("range_id") % 7).alias("start"), hours("end", F.lit(20)).alias("end"))
    return rounded(seconds(asof.best_overlap(spans, found).select("symbol", "start", "found_start", "iou"), "start", "found_start"))


@query("j14_step_lookup", f"WITH {SQL_TRADES} SELECT score::DOUBLE AS score, CASE WHEN score >= 4 THEN 2.0 WHEN score >= 2 THEN 1.0 ELSE 0.5 END::DOUBLE AS size, count(*) AS n FROM trades GROUP BY ALL")
def j14(spark, d):
    return v.trades(spark, d).groupBy(F.col("score").cast("double").alias("score"), sig.step_lookup("score", {0: 0.5, 2: 1.0, 4: 2.0}).alias("size")).agg(F.count("*").alias("n"))


@query("j16_parameter_grid", "SELECT a.stop_atr, b.cooldown, 'stop_atr=' || a.stop_atr || ',cooldown=' || b.cooldown AS scenario FROM (VALUES (1.0::DOUBLE), (1.5), (2.0)) a(stop_atr), (VALUES (3::BIGINT), (6)) b(cooldown)")
def j16(spark, d):
    return backtest.parameter_grid(spark, {"stop_atr": [1.0, 1.5, 2.0], "cooldown": [3, 6]})


# indicators


def _line(name: str, sql_ctes: tuple[str, ...], select: str, build: Callable[[DataFrame], DataFrame], columns: tuple[str, ...]):
    QUERIES[name] = lambda spark, d: _shown(build(v.bars(spark, d)), *columns)
    ORACLE_SQL[name] = _bars(*sql_ctes) + select


_line("w02_atr", (f"t AS (SELECT *, {TR} AS tr FROM bars)",), f"SELECT {OUT}, {_r(_full('avg(tr)', 'tr', 14), 'atr')} FROM t", indicators.atr, ("atr",))
_line(
    "w03_regression", (f"p AS (SELECT *, (row_number() OVER ({W}))::DOUBLE AS x FROM bars)",),
    f"SELECT {OUT}, {_r(_full('regr_slope(close, x)', 'close', 60), 'slope')}, {_r(_full('regr_r2(close, x)', 'close', 60), 'r2')}, {_r(_full('avg(close)', 'close', 60), 'mean')} FROM p",
    lambda df: indicators.regression(df, 60), ("slope", "r2", "mean"),
)
_PIVOT_SQL = f"""piv AS (SELECT *, row_number() OVER ({W}) - 1 AS pos,
  coalesce(count(*) OVER l = 3 AND count(*) OVER r = 3 AND close > max(close) OVER l AND close > max(close) OVER r, false) AS pivot_high,
  coalesce(count(*) OVER l = 3 AND count(*) OVER r = 3 AND close < min(close) OVER l AND close < min(close) OVER r, false) AS pivot_low
  FROM bars WINDOW l AS ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS ({W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))"""
_line("w04_pivots", (_PIVOT_SQL,), f"SELECT {OUT}, pivot_high, pivot_low FROM piv", structure.pivots, ("pivot_high", "pivot_low"))
_KNOWN_SQL = ", ".join(
    f"""{s}_k AS (SELECT symbol, pos + 3 AS known, close AS v, lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS w FROM piv WHERE pivot_{s}),
  {s}_j AS (SELECT p.symbol, p.pos, k.v AS {s}_1, k.w AS {s}_2 FROM piv p ASOF LEFT JOIN {s}_k k ON p.symbol = k.symbol AND p.pos >= k.known)"""
    for s in ("high", "low")
)
_STRUCT_SQL = """SELECT symbol, epoch(ts)::BIGINT AS ts_s, CASE WHEN high_1 > high_2 AND low_1 > low_2 THEN 'bullish' WHEN high_1 < high_2 AND low_1 < low_2 THEN 'bearish' ELSE 'undefined' END AS regime,
  high_1 AS swing_high, low_1 AS swing_low, CAST(CASE WHEN close < low_1 THEN -1 WHEN close > high_1 THEN 1 ELSE 0 END AS BIGINT) AS "break" FROM piv JOIN high_j USING (symbol, pos) JOIN low_j USING (symbol, pos)"""
_line("w06_market_structure", (_PIVOT_SQL, _KNOWN_SQL), _STRUCT_SQL, structure.market_structure, ("regime", "swing_high", "swing_low", "break"))


@query("w07_structure_of_coarser_bars", "WITH " + SQL_BARS.replace("1 HOUR", "4 HOUR") + ", " + _PIVOT_SQL + ", " + _KNOWN_SQL + ", reg AS (" + _STRUCT_SQL + "), " + SQL_BARS.replace("bars AS", "b1 AS") + """
  SELECT b.symbol, epoch(b.ts)::BIGINT AS ts_s, coalesce(r.regime, 'undefined') AS regime FROM b1 b ASOF LEFT JOIN reg r ON b.symbol = r.symbol AND epoch(b.ts)::BIGINT >= r.ts_s + 14400""")
def w07(spark, d):
    return _shown(structure.aligned_structure(v.bars(spark, d), v.bars(spark, d, 4 * HOUR), 4 * HOUR), "regime")


_line(
    "w08_rsi", (f"s AS (SELECT *, close - lag(close) OVER ({W}) AS m FROM bars)", "u AS (SELECT *, CASE WHEN m IS NOT NULL THEN greatest(m, 0) END AS up, CASE WHEN m IS NOT NULL THEN greatest(-m, 0) END AS dn FROM s)",
                f"e AS (SELECT *, {_ewm('up', '1/14')} AS mu, {_ewm('dn', '1/14')} AS md FROM u)"),
    f"SELECT {OUT}, {_r('CASE WHEN md > 0 THEN 100 - 100 / (1 + mu / md) ELSE 100.0 END', 'rsi')} FROM e", indicators.rsi, ("rsi",),
)
_MACD_SQL = (f"f AS (SELECT *, {_ewm('close', '2/13')} - {_ewm('close', '2/27')} AS macd FROM bars)", f"m AS (SELECT *, {_ewm('macd', '2/10')} AS signal FROM f)")
_line("w09_macd", _MACD_SQL, f"SELECT {OUT}, {_r('macd', 'macd')}, {_r('signal', 'signal')}, {_r('macd - signal', 'histogram')} FROM m", indicators.macd, ("macd", "signal", "histogram"))
_line(
    "w12_stochastic", (f"k AS (SELECT *, 100 * (close - {_full('min(low)', 'low', 14)}) / nullif({_full('max(high)', 'high', 14)} - {_full('min(low)', 'low', 14)}, 0) AS k FROM bars)",),
    f"SELECT {OUT}, {_r(_full('avg(k)', 'k', 3), 'stochastic')} FROM k", indicators.stochastic, ("stochastic",),
)
_line(
    "w13_adx", (f"s AS (SELECT *, {TR} AS tr, high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS dn FROM bars)",
                "g AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS dp, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS dm FROM s)",
                f"e AS (SELECT *, 100 * {_ewm('dp', '1/14')} / nullif({_ewm('tr', '1/14')}, 0) AS di_plus, 100 * {_ewm('dm', '1/14')} / nullif({_ewm('tr', '1/14')}, 0) AS di_minus FROM g)",
                "x AS (SELECT *, 100 * abs(di_plus - di_minus) / nullif(di_plus + di_minus, 0) AS dx FROM e)"),
    f"SELECT {OUT}, {_r('di_plus', 'di_plus')}, {_r('di_minus', 'di_minus')}, {_r(_ewm('dx', '1/14'), 'adx')} FROM x", indicators.adx, ("di_plus", "di_minus", "adx"),
)
_BB = f"bb AS (SELECT *, {_full('avg(close)', 'close', 20)} AS mid, {_full('stddev_samp(close)', 'close', 20)} AS dev FROM bars)"
_line(
    "w14_bollinger", (_BB,), f"SELECT {OUT}, {_r('mid', 'bb_mid')}, {_r('mid + 2 * dev', 'bb_up')}, {_r('mid - 2 * dev', 'bb_low')}, {_r('4 * dev / nullif(mid, 0)', 'bb_width')}, {_r('(close - (mid - 2 * dev)) / nullif(4 * dev, 0)', 'bb_pct')} FROM bb",
    indicators.bollinger, ("bb_mid", "bb_up", "bb_low", "bb_width", "bb_pct"),
)
_KC = (f"t AS (SELECT *, {TR} AS tr FROM bars)", f"kc AS (SELECT *, {_ewm('close', '2/21')} AS kmid, {_full('avg(tr)', 'tr', 20)} AS katr FROM t)")
_line("w15_keltner", _KC, f"SELECT {OUT}, {_r('kmid', 'kc_mid')}, {_r('kmid + 1.5 * katr', 'kc_up')}, {_r('kmid - 1.5 * katr', 'kc_low')} FROM kc", indicators.keltner, ("kc_mid", "kc_up", "kc_low"))
_line(
    "w16_squeeze", (_BB, *_KC, """sq AS (SELECT symbol, ts, CASE WHEN dev IS NOT NULL AND katr IS NOT NULL THEN mid + 2 * dev < kmid + 1.5 * katr AND mid - 2 * dev > kmid - 1.5 * katr END AS squeeze FROM bb JOIN kc USING (symbol, ts))""",
                    f"ch AS (SELECT *, CASE WHEN coalesce(squeeze, false) IS DISTINCT FROM lag(coalesce(squeeze, false)) OVER ({W}) THEN 1 ELSE 0 END AS c FROM sq)", f"ru AS (SELECT *, sum(c) OVER ({W}) AS run FROM ch)"),
    f"SELECT {OUT}, squeeze::DOUBLE AS squeeze, row_number() OVER (PARTITION BY symbol, run ORDER BY ts) AS squeeze_bars FROM ru", lambda df: indicators.squeeze(df).withColumn("squeeze", F.col("squeeze").cast("double")), ("squeeze", "squeeze_bars"),
)
_TTM = (f"p AS (SELECT *, (row_number() OVER ({W}))::DOUBLE AS x FROM bars)",
        f"dv AS (SELECT *, close - (({_full('max(high)', 'high', 20)} + {_full('min(low)', 'low', 20)}) / 2 + {_full('avg(close)', 'close', 20)}) / 2 AS dev FROM p)",
        f"tm AS (SELECT *, {_full('regr_slope(dev, x)', 'dev', 20)} AS ttm FROM dv)", f"tp AS (SELECT *, lag(ttm) OVER ({W}) AS before FROM tm)")
_line(
    "w17_ttm_momentum", _TTM, f"""SELECT {OUT}, {_r('ttm', 'ttm')}, CASE WHEN ttm IS NULL OR before IS NULL THEN '' WHEN ttm > 0 AND ttm - before > 0 THEN 'bullish_strong' WHEN ttm > 0 THEN 'bullish_weak'
    WHEN ttm - before > 0 THEN 'bearish_weak' ELSE 'bearish_strong' END AS ttm_phase FROM tp""", indicators.ttm_momentum, ("ttm", "ttm_phase"),
)
_line(
    "w19_impulse", (f"t AS (SELECT *, {TR} AS tr FROM bars)",), f"SELECT {OUT}, {_r(f'abs(close - lag(close, 6) OVER ({W})) / nullif({_full("avg(tr)", "tr", 14)}, 0)', 'impulse')} FROM t",
    lambda df: indicators.impulse(indicators.atr(df)), ("impulse",),
)
_line(
    "w21_rolling_rank", (f"l AS (SELECT *, list(close) OVER ({W} ROWS 119 PRECEDING) AS w FROM bars)",),
    f"SELECT {OUT}, {_r('CASE WHEN len(w) >= 30 THEN (len(list_filter(w, lambda x: x < close)) + (len(list_filter(w, lambda x: x = close)) + 1) / 2) / len(w) END', 'pct_rank')} FROM l",
    lambda df: indicators.rolling_rank(df, "close"), ("pct_rank",),
)
_line(
    "w22_rolling_quantile", (), f"SELECT {OUT}, {_r(f'CASE WHEN count(*) OVER ({W} ROWS 499 PRECEDING) >= 50 THEN quantile_cont(close, 0.95) OVER ({W} ROWS 499 PRECEDING) END', 'quantile')} FROM bars",
    lambda df: indicators.rolling_quantile(df, "close"), ("quantile",),
)


@query("w23_funding_features", "WITH " + SQL_RATES + f"""SELECT symbol, floor(epoch(ts))::BIGINT AS ts_s, round(CASE WHEN count(*) OVER ({W} ROWS 179 PRECEDING) >= 90 THEN (funding - avg(funding) OVER ({W} ROWS 179 PRECEDING)) / nullif(stddev_samp(funding) OVER ({W} ROWS 179 PRECEDING), 0) END, 6) + 0.0 AS funding_z,
  {_r(_full('sum(funding)', 'funding', 6), 'funding_sum')} FROM rates""")
def w23(spark, d):
    return _shown(indicators.funding_features(v.rates(spark, d)), "funding_z", "funding_sum")


_AHEAD = f"({W} ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)"
_line(
    "w26_excursions", (f"t AS (SELECT *, {TR} AS tr FROM bars)", f"a AS (SELECT *, nullif({_full('avg(tr)', 'tr', 14)}, 0) AS atr, max(high) OVER {_AHEAD} AS hi, min(low) OVER {_AHEAD} AS lo, count(*) OVER {_AHEAD} AS n FROM t)",
                       "m AS (SELECT *, CASE WHEN n = 24 THEN (hi - close) / atr END AS mfe, CASE WHEN n = 24 THEN (close - lo) / atr END AS mae FROM a)"),
    f"SELECT {OUT}, {_r('mfe', 'mfe')}, {_r('mae', 'mae')}, round(CASE WHEN mfe IS NOT NULL THEN mfe / greatest(mfe + greatest(mae, 0), 1e-9) END, 6) + 0.0 AS efficiency FROM m",
    lambda df: indicators.excursions(indicators.atr(df)), ("mfe", "mae", "efficiency"),
)


@query("w10_divergences", _bars(*_MACD_SQL, "h AS (SELECT symbol, ts, macd - signal AS m FROM m)", _PIVOT_SQL, *[
    f"""{s}_p AS (SELECT symbol, pos, close, m, lag(pos) OVER w AS p0, lag(close) OVER w AS c0, lag(m) OVER w AS m0 FROM piv JOIN h USING (symbol, ts) WHERE pivot_{s} WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
    {s}_d AS (SELECT symbol, pos + 3 AS pos, '{n}' AS divergence, coalesce(abs(m - m0) / nullif(abs(m) + abs(m0), 0), 0) AS strength FROM {s}_p WHERE pos - p0 <= 40 AND close {op} c0 AND m {back} m0)"""
    for s, n, op, back in (("low", "bullish", "<", ">"), ("high", "bearish", ">", "<"))]) + """SELECT p.symbol, epoch(p.ts)::BIGINT AS ts_s, coalesce(b.divergence, a.divergence, '') AS divergence,
    round(coalesce(b.strength, a.strength, 0), 6) + 0.0 AS strength FROM piv p LEFT JOIN low_d a USING (symbol, pos) LEFT JOIN high_d b USING (symbol, pos)""")
def w10(spark, d):
    return _shown(structure.divergences(indicators.macd(v.bars(spark, d)), "histogram"), "divergence", "strength")


_DIV_SQL = (*_MACD_SQL, "h AS (SELECT symbol, ts, macd - signal AS m FROM m)", _PIVOT_SQL, *[
    f"""{s}_p AS (SELECT symbol, pos, close, m, lag(pos) OVER w AS p0, lag(close) OVER w AS c0, lag(m) OVER w AS m0 FROM piv JOIN h USING (symbol, ts) WHERE pivot_{s} WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
    {s}_d AS (SELECT symbol, pos + 3 AS pos, '{n}' AS divergence, coalesce(abs(m - m0) / nullif(abs(m) + abs(m0), 0), 0) AS strength FROM {s}_p WHERE pos - p0 <= 40 AND close {op} c0 AND m {back} m0)"""
    for s, n, op, back in (("low", "bullish", "<", ">"), ("high", "bearish", ">", "<"))], "found AS (SELECT p.symbol, p.pos, coalesce(b.divergence, a.divergence) AS divergence FROM piv p LEFT JOIN low_d a USING (symbol, pos) LEFT JOIN high_d b USING (symbol, pos))")


@query("w11_standing_divergence", _bars(*_DIV_SQL) + """SELECT p.symbol, epoch(p.ts)::BIGINT AS ts_s, CASE WHEN p.pos - f.pos < 12 THEN f.divergence ELSE '' END AS divergence_alive
  FROM piv p ASOF LEFT JOIN (SELECT * FROM found WHERE divergence IS NOT NULL) f ON p.symbol = f.symbol AND p.pos >= f.pos""")
def w11(spark, d):
    return _shown(structure.standing_divergence(structure.divergences(indicators.macd(v.bars(spark, d)), "histogram")), "divergence_alive")


_line(
    "w22_display_scaling", (f"c AS (SELECT *, close - {_full('avg(close)', 'close', 20)} AS m FROM bars)", f"q AS (SELECT *, CASE WHEN count(m) OVER ({W} ROWS 499 PRECEDING) >= 50 THEN quantile_cont(abs(m), 0.95) OVER ({W} ROWS 499 PRECEDING) END AS q FROM c)"),
    f"SELECT {OUT}, {_r('CASE WHEN m IS NOT NULL AND q IS NOT NULL THEN greatest(-100, least(100, 100 * m / nullif(q, 0))) END', 'scaled')} FROM q",
    lambda df: indicators.display_scaled(df.withColumn("m", F.col("close") - indicators.sma("close", 20)), "m"), ("scaled",),
)
_line(
    "w27_relative_atr", (f"t AS (SELECT *, {TR} AS tr FROM bars)",), f"SELECT {OUT}, {_r(_full('avg(tr)', 'tr', 14) + ' / nullif(close, 0)', 'atr_relative')} FROM t",
    lambda df: indicators.atr(df).withColumn("atr_relative", F.try_divide("atr", F.nullif(F.col("close"), F.lit(0.0)))), ("atr_relative",),
)
# gaps

_GAP_SQL = f"""g0 AS (SELECT *, lag(high, 2) OVER ({W}) AS h1, lag(low, 2) OVER ({W}) AS l1 FROM walk),
gap AS (SELECT symbol, CASE WHEN low > h1 THEN 'bullish' ELSE 'bearish' END AS kind, CASE WHEN low > h1 THEN low ELSE l1 END AS top, CASE WHEN low > h1 THEN h1 ELSE high END AS bottom,
  ts AS formed_at, ts + INTERVAL 1 HOUR AS confirmed_at FROM g0 WHERE low > h1 OR high < l1)"""
_EVO_SQL = """e0 AS (SELECT g.*, w.ts, least(top, greatest(bottom, CASE WHEN kind = 'bullish' THEN min(low) OVER p ELSE max(high) OVER p END)) AS edge FROM gap g JOIN walk w ON w.ts >= g.confirmed_at
  WINDOW p AS (PARTITION BY formed_at ORDER BY w.ts)),
e1 AS (SELECT *, CASE WHEN kind = 'bullish' THEN edge <= bottom ELSE edge >= top END AS spent FROM e0),
evo AS (SELECT * FROM e1 QUALIFY ts <= coalesce(min(CASE WHEN spent THEN ts END) OVER (PARTITION BY formed_at), ts))"""


@query("i01_gap_detection", _walk(_GAP_SQL) + "SELECT symbol, kind, round(top, 6) AS top, round(bottom, 6) AS bottom, epoch(formed_at)::BIGINT AS formed_at_s, epoch(confirmed_at)::BIGINT AS confirmed_at_s FROM gap")
def i01(spark, d):
    return _shown(gaps.detect(v.walk(spark, d), HOUR), "kind", "top", "bottom", times=("formed_at", "confirmed_at"))


@query("i02_gap_evolution", _walk(_GAP_SQL, _EVO_SQL) + "SELECT symbol, 'ALL/' || epoch(formed_at)::BIGINT AS gap_id, epoch(ts)::BIGINT AS ts_s, round(edge, 6) AS edge, NOT spent AS alive FROM evo")
def i02(spark, d):
    w = _walked(spark, d)
    return _shown(gaps.evolution(gaps.detect(w, HOUR), w), "gap_id", "edge", "alive")


@query("i03_gap_targets", _walk(_GAP_SQL, _EVO_SQL) + "SELECT symbol, 'ALL/' || epoch(formed_at)::BIGINT AS gap_id, epoch(ts)::BIGINT AS ts_s, round(edge, 6) AS edge, round((edge + CASE WHEN kind = 'bullish' THEN bottom ELSE top END) / 2, 6) AS mid FROM evo WHERE NOT spent")
def i03(spark, d):
    w = _walked(spark, d)
    return _shown(gaps.target_points(gaps.detect(w, HOUR), w), "gap_id", "edge", "mid")


_AT = 1705276800  # 2024-01-15


@query("i04_gaps_alive", _walk(_GAP_SQL, _EVO_SQL.replace("JOIN walk w ON", "JOIN walk w ON epoch(w.ts) <= 1705276800 AND")) + """, n AS (SELECT formed_at, arg_max(edge, ts) AS edge, bool_and(NOT spent) AS alive FROM evo GROUP BY formed_at)
  SELECT symbol, kind, round(CASE WHEN kind = 'bullish' THEN coalesce(edge, top) ELSE top END, 6) AS top, round(CASE WHEN kind = 'bearish' THEN coalesce(edge, bottom) ELSE bottom END, 6) AS bottom, epoch(formed_at)::BIGINT AS formed_at_s
  FROM gap LEFT JOIN n USING (formed_at) WHERE epoch(confirmed_at) <= 1705276800 AND coalesce(alive, true)""")
def i04(spark, d):
    w = _walked(spark, d)
    return _shown(gaps.alive_at(gaps.detect(w, HOUR), w, F.timestamp_seconds(F.lit(_AT))), "kind", "top", "bottom", times=("formed_at",))


@query("i05_gap_staircase", _walk(_GAP_SQL, _EVO_SQL) + """SELECT symbol, 'ALL/' || epoch(formed_at)::BIGINT AS gap_id, epoch(ts)::BIGINT AS ts_s, round(edge, 6) AS edge FROM evo WHERE NOT spent
  QUALIFY edge IS DISTINCT FROM lag(edge) OVER (PARTITION BY formed_at ORDER BY ts)""")
def i05(spark, d):
    w = _walked(spark, d)
    return _shown(gaps.staircase(gaps.detect(w, HOUR), w), "gap_id", "edge")


# profiles and levels

_BINS = 200
_BIN_SQL = f"""inside AS (SELECT range_id, high, low, volume FROM spans s JOIN walk w ON w.ts BETWEEN s."start" AND s."end"),
lim AS (SELECT range_id, min(low) AS lo, max(high) AS hi FROM inside GROUP BY range_id HAVING sum(volume) > 0 AND max(high) > min(low)),
pos AS (SELECT *, (hi - lo) / {_BINS} AS width FROM inside JOIN lim USING (range_id)),
kk AS (SELECT *, greatest(0, least({_BINS - 1}, floor((low - lo) / width)))::INTEGER AS k0, greatest(0, least({_BINS - 1}, floor((high - lo) / width)))::INTEGER AS k1 FROM pos),
ex AS (SELECT *, unnest(generate_series(k0, CASE WHEN high > low THEN k1 ELSE k0 END))::INTEGER AS bin FROM kk),
prof AS (SELECT range_id, lo, hi, bin, sum(CASE WHEN high > low THEN volume * greatest(0, least(high, lo + (bin + 1) * width) - greatest(low, lo + bin * width)) / (high - low) ELSE volume END) AS volume FROM ex GROUP BY ALL)"""
_PROFILE = ProfileConfig(bins=_BINS)


@query("v01_volume_by_bin", _walk(_SPANS_SQL, _BIN_SQL) + "SELECT range_id, bin, round(volume, 6) + 0.0 AS volume FROM prof")
def v01(spark, d):
    return rounded(profile.volume_by_bin(v.walk(spark, d), _spans(spark, d), _PROFILE).select("range_id", "bin", "volume"))


@query("v04_profile_levels", _walk(_SPANS_SQL, _BIN_SQL, f"""arr AS (SELECT range_id, lo, hi, list(coalesce(volume, 0.0) ORDER BY b) AS vs, arg_min(b, (-round(coalesce(volume, 0), 9), abs(b - {(_BINS - 1) / 2}), b)) AS peak, sum(volume) AS total
  FROM (SELECT range_id, lo, hi, unnest(generate_series(0, {_BINS - 1}))::INTEGER AS b FROM lim) g LEFT JOIN (SELECT range_id, bin AS b, volume FROM prof) p USING (range_id, b) GROUP BY range_id, lo, hi)""").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
  grow AS (SELECT range_id, lo, hi, vs, total, peak, peak AS a, peak AS b, vs[peak + 1] AS held FROM arr
    UNION ALL SELECT range_id, lo, hi, vs, total, peak, CASE WHEN up >= dn THEN a ELSE greatest(0, a - 2) END, CASE WHEN up >= dn THEN least({_BINS - 1}, b + 2) ELSE b END, held + greatest(up, dn)
    FROM (SELECT *, CASE WHEN b >= {_BINS - 1} THEN -1 ELSE coalesce(vs[b + 2], 0) + coalesce(vs[b + 3], 0) END AS up,
      CASE WHEN a <= 0 THEN -1 ELSE vs[a] + CASE WHEN a >= 2 THEN vs[a - 1] ELSE 0 END END AS dn FROM grow WHERE held < total * 0.7 AND (a > 0 OR b < {_BINS - 1})))
  SELECT range_id, round(lo + (any_value(peak) + 0.5) * (hi - lo) / {_BINS}, 7) AS poc, round(lo + (max(b) + 1) * (hi - lo) / {_BINS}, 7) AS vah, round(lo + min(a) * (hi - lo) / {_BINS}, 7) AS val, round(any_value(total), 7) AS volume_total
  FROM grow GROUP BY range_id, lo, hi""")
def v04(spark, d):
    return rounded(profile.profiles(v.walk(spark, d), _spans(spark, d), _PROFILE).drop("volumes"), 7)


@query("a18_rebinned_profile", _walk(_SPANS_SQL, _BIN_SQL) + f'SELECT range_id, CAST(floor(bin * 20 / {_BINS}) AS BIGINT) AS "group", round(avg(lo + (bin + 0.5) * (hi - lo) / {_BINS}), 8) AS price, round(sum(volume), 8) AS volume FROM prof GROUP BY ALL')
def a18(spark, d):
    return rounded(profile.rebinned(profile.volume_by_bin(v.walk(spark, d), _spans(spark, d), _PROFILE), _BINS, 20), 8)


def _walked(spark: SparkSession, d: str) -> DataFrame:
    """The walk's candles, worked out once for several readers."""
    return store.written(v.walk(spark, d))


def _weekly_levels(spark: SparkSession, d: str, walks: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Levels at the quarter points of each finished week's range: a plain grid
    for touch queries."""
    w = walks() if walks else v.walk(spark, d)
    weeks = w.groupBy("symbol", F.floor(F.unix_seconds("ts") / WEEK).alias("week")).agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    three = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * s, 2).alias("price")) for n, s in (("val", 0.25), ("poc", 0.5), ("vah", 0.75))]))
    return weeks.select("symbol", F.col("week").cast("string").alias("range_id"), three.alias("x"), F.timestamp_seconds((F.col("week") + 1) * WEEK).alias("valid_from")).select("symbol", "range_id", "x.*", "valid_from", F.lit(0.5).alias("quality"))


_LEVEL_SQL = """weeks AS (SELECT symbol, floor(epoch(ts) / 604800)::BIGINT AS week, min(low) AS lo, max(high) AS hi FROM walk GROUP BY ALL),
levels AS (SELECT symbol, week::VARCHAR AS range_id, u.level, round(lo + (hi - lo) * u.s, 2) AS price, (week + 1) * 604800 AS valid_s FROM weeks, (VALUES ('val', 0.25::DOUBLE), ('poc', 0.5), ('vah', 0.75)) u(level, s))"""
_TOUCH_SQL = """nx AS (SELECT symbol, ts, close, lead(ts) OVER w AS next_ts, lead(low) OVER w AS low, lead(high) OVER w AS high FROM walk WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
touch AS (SELECT n.symbol, epoch(ts)::BIGINT AS ts_s, epoch(next_ts)::BIGINT AS next_ts_s, range_id, level, price, CASE WHEN close > price THEN 1 ELSE -1 END AS direction
  FROM nx n JOIN levels l ON epoch(n.ts) >= l.valid_s AND l.price BETWEEN n.low AND n.high AND l.price <> n.close)"""


@query("b21_touches", _walk(_LEVEL_SQL, _TOUCH_SQL) + "SELECT * FROM touch")
def b21(spark, d):
    w = _walked(spark, d)
    return _shown(profile.touches(w, _weekly_levels(spark, d, lambda: w)), "range_id", "level", "price", "direction", times=("ts", "next_ts"))


@query("v08_target_picking", _walk(_LEVEL_SQL, _TOUCH_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + """, grid AS (SELECT t.*, row_number() OVER () AS rid FROM touch t),
  cand AS (SELECT rid, price AS entry, direction, list(p ORDER BY p * direction) AS ps FROM (SELECT g.rid, g.price, g.direction, l.price AS p FROM grid g JOIN levels l ON (l.price - g.price) * g.direction > 0) GROUP BY ALL),
  step AS (SELECT rid, entry, direction, ps, 1 AS i, entry AS ref, [] ::DOUBLE[] AS taken FROM cand
    UNION ALL SELECT rid, entry, direction, ps, i + 1, CASE WHEN ok THEN ps[i] ELSE ref END, CASE WHEN ok THEN list_append(taken, ps[i]) ELSE taken END
    FROM (SELECT *, len(taken) < 3 AND abs(ps[i] - ref) >= abs(ref) * CASE WHEN len(taken) = 0 THEN 0.01 ELSE 0.005 END AS ok FROM step WHERE i <= len(ps)))
  SELECT g.symbol, g.ts_s, g.range_id, g.level, array_to_string(list_transform(coalesce(arg_max(s.taken, s.i), []), lambda x: round(x, 2)::VARCHAR), ';') AS targets FROM grid g LEFT JOIN step s USING (rid) GROUP BY g.rid, g.symbol, g.ts_s, g.range_id, g.level""")
def v08(spark, d):
    w = _walked(spark, d)
    levels = store.written(_weekly_levels(spark, d, lambda: w))
    picked = profile.picked_targets(profile.touches(w, levels), levels, 0.005, 3, 0.01)
    return _shown(picked.withColumn("targets", F.array_join(F.transform("targets", lambda p: F.round(p, 2).cast("string")), ";")), "range_id", "level", "targets")


# ranges and simulation

#: The walk is far rougher than the markets the defaults were tuned on.
DETECTION = RangeConfig(max_height_atr=14.0, min_crossings=3, min_containment=0.80, band_atr=2.5, min_quality={"primary": 0.0, "secondary": 0.0})
SIMULATION = BacktestConfig(kinds=("primary", "secondary"), max_adx=60.0, min_impulse=0.2)


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    return store.written(ranges.detect(v.walk(spark, d), DETECTION))  # few rows, which selections read several times


@query("r01_flat_windows", _walk(f"p AS (SELECT *, (row_number() OVER ({W}))::DOUBLE AS x FROM walk)", f"q AS (SELECT symbol, {_full('regr_r2(close, x)', 'close', 60)} AS r2 FROM p)") + "SELECT symbol, count(r2) AS n_full, CAST(sum(CASE WHEN r2 < 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS n_flat FROM q GROUP BY symbol")
def r01(spark, d):
    return ranges.prefilter_share(v.walk(spark, d), 60)


def _range_sql() -> str:
    """Range detection as SQL: all candidates of all windows at once, then the
    chain of those that may follow each other."""
    c = DETECTION
    lines, calms = [], []
    for i, w in enumerate(c.windows):
        n, edge = w.bars, c.edge_bars(w.bars)
        lines.append(f"""SELECT {i} AS place, {n} AS n, '{w.kind}' AS kind, {edge} AS edge, {c.touch_gap(n)} AS gap, {c.height_cap(n)!r}::DOUBLE AS cap, {int(n * c.min_duration_fraction)} AS least,
          symbol, pos AS t, atr, regr_slope(close, pos) OVER f AS slope, regr_r2(close, pos) OVER f AS r2, count(*) OVER f AS full_n FROM b WINDOW f AS ({W} ROWS {n - 1} PRECEDING)""")
        calms.append(f"SELECT {n} AS n, pos, coalesce(regr_r2(close, pos) OVER ({W} ROWS BETWEEN CURRENT ROW AND {edge - 1} FOLLOWING) < {c.max_r2}, true) AS calm FROM b")
    piv = "count(*) OVER {0} = 3 AND count(*) OVER {1} = 3 AND close {2} {3}(close) OVER {0} AND close {2} {3}(close) OVER {1}"
    share = f">= {c.min_containment}"

    def side(name: str, sign: str) -> str:
        """The outermost pivot price that two or more separate pivots come near."""
        return f"""{name}_p AS (SELECT n, t, gap, cand.atr * {c.band_atr} AS band, p.pos, {sign} p.close AS v FROM cand JOIN b p ON p.pos BETWEEN t - n + 1 AND t - {c.pivot_bars} AND p.pivot_{name}),
        {name}_l AS (SELECT x.n, x.t, x.v, any_value(x.gap) AS gap, list(y.pos ORDER BY y.pos) AS places FROM (SELECT DISTINCT n, t, gap, band, v FROM {name}_p) x JOIN {name}_p y ON x.n = y.n AND x.t = y.t AND y.v <= x.v AND y.v >= x.v - x.band GROUP BY x.n, x.t, x.v),
        {name}_s AS (SELECT n, t, {sign} max(v) AS v, arg_max(list_reduce(list_transform(places, lambda q: {{'k': 1, 'q': q}}), lambda m, q: CASE WHEN q.q - m.q >= gap THEN {{'k': m.k + 1, 'q': q.q}} ELSE m END).k, v) AS touches
          FROM {name}_l WHERE places[-1] - places[1] >= gap GROUP BY n, t)"""

    def changes(name: str, marks: str) -> str:
        return f"""{name}_m AS (SELECT n, t, pos, {marks} AS m FROM win), {name}_c AS (SELECT n, t, m, lag(m) OVER (PARTITION BY n, t ORDER BY pos) AS before FROM {name}_m WHERE m <> 0),
        {name} AS (SELECT n, t, count(*) FILTER (m <> before) AS {name} FROM {name}_c GROUP BY n, t)"""

    return _walk(
        f"t0 AS (SELECT *, {TR} AS tr, (row_number() OVER ({W}) - 1)::DOUBLE AS pos FROM walk)",
        f"b AS (SELECT *, {_full('avg(tr)', 'tr', c.atr_period)} AS atr, coalesce({piv.format('l', 'r', '>', 'max')}, false) AS pivot_high, coalesce({piv.format('l', 'r', '<', 'min')}, false) AS pivot_low FROM t0"
        f" WINDOW l AS ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS ({W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))",
        "calm AS (" + " UNION ALL ".join(calms) + ")", "lines AS (" + " UNION ALL ".join(lines) + ")", f"cand AS MATERIALIZED (SELECT * FROM lines WHERE full_n = n AND r2 < {c.max_r2} AND atr > 0)", side("high", ""), side("low", "-"),
        "rect AS MATERIALIZED (SELECT cand.*, h.v AS ceiling, l.v AS floor, h.touches AS touches_ceiling, l.touches AS touches_floor, h.v - l.v AS height FROM cand JOIN high_s h USING (n, t) JOIN low_s l USING (n, t) WHERE h.v > l.v)",
        "win AS MATERIALIZED (SELECT n, t, pos, close, ceiling, floor, height, CASE WHEN close BETWEEN floor AND ceiling THEN 0 ELSE 1 END AS o FROM rect JOIN b ON pos BETWEEN t - n + 1 AND t)",
        f"runs AS (SELECT n, t, sum(o) OVER (PARTITION BY n, t ORDER BY pos ROWS {c.closes_outside - 1} PRECEDING) AS k FROM win)",
        changes("crossings", "sign(close - (ceiling + floor) / 2)"), changes("trips", f"CASE WHEN close <= floor + {c.edge_band} * height THEN -1 WHEN close >= ceiling - {c.edge_band} * height THEN 1 ELSE 0 END"),
        f"""good AS MATERIALIZED (SELECT rect.*, containment, crossings FROM rect JOIN (SELECT n, t, 1 - avg(o) AS containment FROM win GROUP BY n, t) USING (n, t) JOIN (SELECT n, t, max(k) AS longest FROM runs GROUP BY n, t) USING (n, t)
          JOIN crossings USING (n, t) JOIN trips USING (n, t) WHERE height / atr <= cap AND height / floor <= {c.max_height_pct} AND containment {share} AND longest < {c.closes_outside} AND crossings >= {c.min_crossings}
          AND trips >= {c.min_trips} + greatest(0, height / floor - {c.free_height_pct}) / {c.pct_per_trip} AND abs(slope) * n < {c.max_drift} * height)""",
        "every AS MATERIALIZED (SELECT n, t, edge, pos, CASE WHEN close BETWEEN floor AND ceiling THEN 1 ELSE 0 END AS i FROM good JOIN b ON true)",
        f"held AS MATERIALIZED (SELECT *, sum(i) OVER (PARTITION BY n, t ORDER BY pos) AS s, {c.closes_outside} = count(*) OVER k AND 0 = sum(i) OVER k AS broken FROM every WINDOW k AS (PARTITION BY n, t ORDER BY pos ROWS {c.closes_outside - 1} PRECEDING))",
        "since AS (SELECT n, t, coalesce(max(pos) FILTER (broken AND pos <= t - n) + 1, 0) AS a FROM held GROUP BY n, t)",
        f"upto AS (SELECT n, t, a, min(pos) FILTER (broken AND pos - {c.closes_outside - 1} >= a) AS confirmed, max(pos) AS last FROM held JOIN since USING (n, t) GROUP BY n, t, a)",
        f"body AS MATERIALIZED (SELECT h.*, u.confirmed, max(h.pos) FILTER (i = 1) OVER (PARTITION BY n, t) AS z FROM held h JOIN upto u USING (n, t) WHERE h.pos BETWEEN a AND coalesce(confirmed - {c.closes_outside}, last))",
        # shares of bars inside from running sums; x.s - x.i is the sum before a bar
        f"first AS (SELECT x.n, x.t, min(x.pos) AS a2 FROM body x JOIN body y ON x.n = y.n AND x.t = y.t AND y.pos = x.z WHERE x.i = 1 AND (y.s - x.s + x.i) / (y.pos - x.pos + 1) {share} GROUP BY x.n, x.t)",
        f"""head AS (SELECT x.n, x.t, min(x.pos) AS a3 FROM body x JOIN first f USING (n, t) JOIN body y ON x.n = y.n AND x.t = y.t AND y.pos = least(x.z, x.pos + x.edge - 1) JOIN calm ON calm.n = x.n AND calm.pos = x.pos
          WHERE x.i = 1 AND x.pos BETWEEN a2 AND x.z AND (y.s - x.s + x.i) / (y.pos - x.pos + 1) {share} AND (calm OR x.pos + x.edge - 1 > x.z) GROUP BY x.n, x.t)""",
        "begun AS (SELECT f.n, f.t, coalesce(a3, z) AS a3, z FROM first f JOIN (SELECT DISTINCT n, t, z FROM body) USING (n, t) LEFT JOIN head USING (n, t))",
        f"""tail AS (SELECT x.n, x.t, max(x.pos) AS z2 FROM body x JOIN begun g USING (n, t) JOIN body y ON x.n = y.n AND x.t = y.t AND y.pos = greatest(a3, x.pos - x.edge + 1)
          WHERE x.i = 1 AND x.pos BETWEEN a3 AND x.z AND (x.s - y.s + y.i) / (x.pos - y.pos + 1) {share} GROUP BY x.n, x.t)""",
        "acc AS MATERIALIZED (SELECT g.*, a3, coalesce(z2, a3) AS z2, confirmed FROM good g JOIN begun USING (n, t) LEFT JOIN tail USING (n, t) JOIN upto USING (n, t) WHERE coalesce(z2, a3) - a3 + 1 >= least)",
        "follow AS MATERIALIZED (SELECT x.n, x.t, min(y.t) AS nt FROM acc x JOIN acc y ON x.n = y.n AND x.confirmed IS NOT NULL AND y.t > greatest(x.t, x.confirmed) GROUP BY x.n, x.t)",
        "chain AS (SELECT n, min(t) AS t FROM acc GROUP BY n UNION ALL SELECT c.n, f.nt FROM chain c JOIN follow f USING (n, t))",
        "found AS (SELECT acc.*, CASE WHEN a3 > coalesce(max(z2) OVER (PARTITION BY n ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS opens FROM acc JOIN chain USING (n, t))",
        f"""ranges AS MATERIALIZED (SELECT f.symbol, CAST(f.n AS INTEGER) AS "window", kind, epoch(p.ts)::BIGINT AS start_s, epoch(q.ts)::BIGINT AS end_s, epoch(d.ts)::BIGINT AS declared_at_s, epoch(k.ts)::DOUBLE AS confirmed_at_s, ceiling, floor,
          (SELECT max(high) FROM b WHERE pos BETWEEN a3 AND z2) AS price_max, (SELECT min(low) FROM b WHERE pos BETWEEN a3 AND z2) AS price_min,
          round(greatest(0, least(1, (1 - height / f.atr / cap + 1 - r2 / {c.max_r2} + (containment - {c.min_containment}) / {1 - c.min_containment!r}) / 3)), 3) AS quality, containment, height / f.atr AS height_atr, r2,
          crossings::INTEGER AS crossings, touches_ceiling::INTEGER AS touches_ceiling, touches_floor::INTEGER AS touches_floor, confirmed IS NULL AS open_ended, CAST(sum(opens) OVER (ORDER BY place, t) - 1 AS INTEGER) AS overlap_group
          FROM found f JOIN b p ON p.pos = a3 JOIN b q ON q.pos = z2 JOIN b d ON d.pos = t LEFT JOIN b k ON k.pos = confirmed)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)


_RANGE_SQL = _range_sql()
_RANGE_OUT = """symbol, "window", kind, start_s, end_s, declared_at_s, confirmed_at_s, round(ceiling, 6) AS ceiling, round(floor, 6) AS floor, round(price_max, 6) AS price_max, round(price_min, 6) AS price_min, quality, round(containment, 6) AS containment,
  round(height_atr, 6) AS height_atr, round(r2, 6) AS r2, crossings, touches_ceiling, touches_floor, open_ended, overlap_group"""


def _chosen_sql(rows: str, by: str) -> str:
    """Greedy choice from ``rows`` in each group of ``by``, heaviest first, as a fold."""
    return f""", ord AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY quality * (end_s - start_s) DESC, start_s DESC, end_s DESC, "window" DESC, declared_at_s DESC) AS rn FROM {rows}),
  fold AS (SELECT {by}, 0::BIGINT AS rn, []::STRUCT(a BIGINT, z BIGINT)[] AS taken, false AS ok FROM ord WHERE rn = 1
    UNION ALL SELECT {", ".join("o." + x for x in by.split(", "))}, o.rn, CASE WHEN ok THEN list_append(p.taken, {{'a': o.start_s, 'z': o.end_s}}) ELSE p.taken END, ok
    FROM (SELECT f.* EXCLUDE (ok), o.rn AS orn, len(list_filter(f.taken, lambda x: (least(x.z, o.end_s) - greatest(x.a, o.start_s)) / (greatest(x.z, o.end_s) - least(x.a, o.start_s)) > {DETECTION.max_overlap})) = 0 AS ok FROM fold f JOIN ord o USING ({by}) WHERE o.rn = f.rn + 1) p
    JOIN ord o USING ({by}) WHERE o.rn = p.orn)
  SELECT {_RANGE_OUT} FROM ord JOIN fold USING ({by}, rn) WHERE fold.ok"""


def _ranges_shown(df: DataFrame) -> DataFrame:
    shown = seconds(df, "start", "end", "declared_at", "confirmed_at")
    return rounded(shown.withColumn("confirmed_at_s", F.col("confirmed_at_s").cast("double")))  # null while the range is open


@query("r12_detected_ranges", _RANGE_SQL + f"SELECT {_RANGE_OUT} FROM ranges")
def r12(spark, d):
    return _ranges_shown(ranges.detect(v.walk(spark, d), DETECTION))


@query("r13_selected_ranges", _RANGE_SQL[:-1] + _chosen_sql("ranges", "kind"))
def r13(spark, d):
    return _ranges_shown(ranges.select(_ranges(spark, d), DETECTION))


@query("r14_causal_ranges", _RANGE_SQL[:-1] + """, known AS (SELECT m.moment, r.* FROM (SELECT DISTINCT kind, confirmed_at_s AS moment FROM ranges WHERE confirmed_at_s IS NOT NULL) m JOIN ranges r ON r.kind = m.kind AND r.confirmed_at_s <= m.moment)"""
       + _chosen_sql("known", "kind, moment") + " AND moment = confirmed_at_s")
def r14(spark, d):
    return _ranges_shown(ranges.select_causally(_ranges(spark, d), DETECTION))


def range_levels(spark: SparkSession, d: str, causal: bool = False) -> DataFrame:
    """The level grid of the selected ranges, profiled on the fine candles."""
    hourly = store.written(v.walk(spark, d))
    found = ranges.detect(hourly, DETECTION)
    # a few rows that five plans below start from
    chosen = store.written(ranges.numbered(ranges.select_causally(found, DETECTION) if causal else ranges.select(found, DETECTION)))
    levels = profile.graded_profiles(chosen, hourly, {"fine": v.walk(spark, d, 900), "middle": hourly, "coarse": v.walk(spark, d, 4 * HOUR)}, _PROFILE)
    return profile.level_grid(chosen, levels, SIMULATION.kinds)


def _grid_sql() -> str:
    """The level grid of the chosen ranges: bars by grade, then the profile of
    ``v04`` over them."""
    profiled = ORACLE_SQL["v04_profile_levels"]
    profiled = profiled[profiled.index("lim AS (") :]
    return sql_ranges_with({"fine": "15 MINUTE", "coarse": "4 HOUR"}) + _chosen_sql("ranges", "kind").split("\n  SELECT ")[0] + f""",
  chosen AS (SELECT o.*, o.symbol || '/' || o."window" || '/' || o.declared_at_s AS range_id FROM ord o JOIN fold USING (kind, rn) WHERE fold.ok),
  graded AS (SELECT range_id, start_s, end_s, CASE WHEN count(*) < 60 THEN 'fine' WHEN count(*) <= 200 THEN 'middle' ELSE 'coarse' END AS grade
    FROM chosen JOIN walk w ON epoch(w.ts) BETWEEN start_s AND end_s GROUP BY ALL),
  met AS ({" UNION ALL ".join(f"SELECT range_id, high, low, volume FROM graded JOIN {t} w ON grade = '{g}' AND epoch(w.ts) BETWEEN start_s AND end_s" for t, g in (("fine", "fine"), ("walk", "middle"), ("coarse", "coarse")))}),
  lv AS (WITH RECURSIVE inside AS (SELECT * FROM met), {profiled})
  SELECT symbol, range_id, "window", kind, u.level, round(CASE u.level WHEN 'val' THEN val WHEN 'poc' THEN poc ELSE vah END, 6) AS price, round(quality, 6) AS quality,
    confirmed_at_s::BIGINT AS valid_from_s, start_s, end_s FROM chosen JOIN lv USING (range_id), (VALUES ('val'), ('poc'), ('vah')) u(level) WHERE confirmed_at_s IS NOT NULL"""


def sql_ranges_with(walks: dict[str, str]) -> str:
    """``_RANGE_SQL`` with walks of other steps beside its own."""
    more = ", ".join(sql_walk(step, name) for name, step in walks.items())
    return _RANGE_SQL[:-1].replace(sql_walk() + ",", sql_walk() + ", " + more + ",", 1)


@query("v06_level_grid", _grid_sql())
def v06(spark, d):
    return v.seconds(rounded(range_levels(spark, d)), "valid_from", "start", "end")


_DRAW = "CAST('0x' || substr(md5('%s20260902/' || run || '/' || symbol || '/' || range_id || '/' || level), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query("v07_displaced_grids", _walk(_LEVEL_SQL, f"""moved AS (SELECT *, (0.03::DOUBLE + 0.12::DOUBLE * {_DRAW % 'size'}) * CASE WHEN {_DRAW % 'sign'} < 0.5 THEN -1.0::DOUBLE ELSE 1 END AS move FROM levels, (SELECT unnest(generate_series(1, 20))::INTEGER AS run) r)""")
       + "SELECT symbol, range_id, level, round(price * (1 + move), 6) AS price, valid_s AS valid_from_s, 0.5::DOUBLE AS quality, run FROM moved")
def v07(spark, d):
    return v.seconds(rounded(profile.displaced(_weekly_levels(spark, d))), "valid_from")


def _simulated(spark: SparkSession, d: str, levels: DataFrame, variants: dict | None = None, config: BacktestConfig = SIMULATION, walks: Callable[..., DataFrame] | None = None) -> DataFrame:
    walks = walks or (lambda step=HOUR: v.walk(spark, d, step))
    w = store.written(walks())
    feats = backtest.features(w, config)
    zones = gaps.target_points(gaps.detect(walks(WEEK), WEEK), w)
    bars = store.written(backtest.decision_bars(feats, walks(900), HOUR, zones))
    return backtest.simulate(bars, levels, config, variants)


@query("b01_simulated_trades")
def b01(spark, d):
    return rounded(_simulated(spark, d, _weekly_levels(spark, d)))


@query("b01_range_level_trades")
def b01r(spark, d):
    return rounded(_simulated(spark, d, range_levels(spark, d)))


@query("b18_control_runs")
def b18(spark, d):
    levels = _weekly_levels(spark, d)
    runs = profile.displaced(levels, 20).withColumn("scenario", F.concat(F.lit("control-"), F.col("run").cast("string"))).drop("run")
    trades = _simulated(spark, d, levels.withColumn("scenario", F.lit("real")).unionByName(runs))
    return rounded(metrics.summary(store.written(trades), 10_000.0, ("scenario",)))


_SWEEP = {f"stop-{s}-cool-{k}": {"stop_atr": s, "cooldown": k} for s in (1.0, 1.5, 2.0) for k in (3, 6)}


@query("b20_parameter_sweep")
def b20(spark, d):
    levels = _weekly_levels(spark, d).withColumn("scenario", F.explode(F.array(*[F.lit(n) for n in _SWEEP])))
    trades = _simulated(spark, d, levels, _SWEEP)
    parts = store.written(backtest.halves(trades, v.walk(spark, d)))
    return rounded(metrics.worst_of(metrics.summary(parts, 10_000.0, ("scenario", "half")), ["scenario"], least=1))


@query("b19_variants")
def b19(spark, d):
    ways = {"base": {}, "all-at-first": {"shares": (1.0, 0.0, 0.0)}, "no-filters": {"max_adx": None, "avoid_squeeze": False, "min_impulse": None}, "with-trend": {"structure_mode": "with"}}
    levels = _weekly_levels(spark, d).withColumn("scenario", F.explode(F.array(*[F.lit(n) for n in ways])))
    return rounded(metrics.summary(store.written(_simulated(spark, d, levels, ways)), 10_000.0, ("scenario",)))


@query("b22_entry_quality", _walk(_LEVEL_SQL, _TOUCH_SQL, f"""tt AS (SELECT *, {TR} AS tr FROM walk)""", f"""ah AS (SELECT symbol, epoch(ts)::BIGINT AS next_ts_s, nullif({_full('avg(tr)', 'tr', 14)}, 0) AS atr, max(high) OVER {_AHEAD} AS hi, min(low) OVER {_AHEAD} AS lo FROM tt)""",
    "m AS (SELECT t.*, CASE WHEN direction > 0 THEN hi - price ELSE price - lo END / atr AS mfe, CASE WHEN direction > 0 THEN price - lo ELSE hi - price END / atr AS mae FROM touch t JOIN ah USING (symbol, next_ts_s))") + """SELECT symbol, ts_s, range_id, level,
    round(mfe, 6) + 0.0 AS mfe, round(mae, 6) + 0.0 AS mae, round(CASE WHEN mfe IS NOT NULL THEN mfe / greatest(mfe + greatest(mae, 0), 1e-9) END, 6) + 0.0 AS efficiency FROM m""")
def b22(spark, d):
    w = _walked(spark, d)
    return _shown(backtest.entry_quality(indicators.atr(w), profile.touches(w, _weekly_levels(spark, d, lambda: w))), "range_id", "level", "mfe", "mae", "efficiency")


_RANDOM_SQL = """pb AS (SELECT symbol, row_number() OVER (ORDER BY ts) - 1 AS pos, close, nullif(atr, 0) AS unit, max(high) OVER f AS hi, min(low) OVER f AS lo FROM (SELECT *, {ATR} AS atr FROM tt) WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)),
  fa AS (SELECT (SELECT count(*) FROM walk) AS n, (SELECT avg(CASE WHEN direction > 0 THEN 1.0::DOUBLE ELSE 0 END) FROM touch) AS long_share),
  tk AS (SELECT run, '7/' || run || '/' || symbol || '/' || ts_s || '/' || range_id || '/' || level AS key FROM touch, generate_series(1, 400) g(run)),
  td AS (SELECT run, 20 + floor(CAST('0x' || substr(md5('bar' || key), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * (n - 44))::BIGINT AS pos, CAST('0x' || substr(md5('side' || key), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < long_share AS is_long FROM tk, fa),
  te AS (SELECT run, CASE WHEN is_long THEN hi - close ELSE close - lo END / unit AS mfe, CASE WHEN is_long THEN close - lo ELSE hi - close END / unit AS mae FROM td JOIN pb USING (pos)),
  tr AS (SELECT run, avg(mfe) AS mfe, avg(mae) AS mae, avg(CASE WHEN mfe IS NOT NULL THEN mfe / greatest(mfe + greatest(mae, 0), 1e-9) END) AS efficiency FROM te GROUP BY run)""".replace("{ATR}", _full("avg(tr)", "tr", 14))


def _random_control(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    walk = _walked(spark, d)
    w = indicators.atr(walk)
    touched = profile.touches(w, _weekly_levels(spark, d, lambda: walk))
    return backtest.random_entries(w, touched), backtest.entry_quality(w, touched)


@query("b22_random_control", _walk(_LEVEL_SQL, _TOUCH_SQL, f"tt AS (SELECT *, {TR} AS tr FROM walk)", _RANDOM_SQL) + "SELECT CAST(run AS INTEGER) AS run, round(mfe, 6) AS mfe, round(mae, 6) AS mae, round(efficiency, 6) AS efficiency FROM tr")
def b22_random(spark, d):
    return rounded(_random_control(spark, d)[0])


@query("a12_beaten_share", ORACLE_SQL["b22_entry_quality"].split("SELECT symbol, ts_s, range_id, level,")[0] + ", " + _RANDOM_SQL + """, real AS (SELECT avg(CASE WHEN mfe IS NOT NULL THEN mfe / greatest(mfe + greatest(mae, 0), 1e-9) END) AS e FROM m)
  SELECT avg(CASE WHEN efficiency < e THEN 1.0::DOUBLE ELSE 0 END) AS share_below FROM tr, real""")
def a12_beaten(spark, d):
    runs, real = _random_control(spark, d)
    mean = real.agg(F.avg("efficiency").alias("real"))  # one row
    return metrics.beaten_share(runs.join(F.broadcast(mean)), F.col("real"), "efficiency")


@query("f_last_target_and_opacity", f"WITH {SQL_TRADES} SELECT seq, CASE bars % 4 WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 2.5 WHEN 3 THEN 3.5 END AS last_target, round(0.25 + 0.65 * least(1.0, greatest(0.0, mfe_atr / 2)), 6) AS opacity FROM trades")
def f_last_target(spark, d):
    t = v.trades(spark, d).withColumns({"t1": F.lit(1.5), "t2": F.lit(2.5), "t3": F.lit(3.5)})
    return rounded(t.select("seq", sig.last_target(F.col("bars") % 4, "t1", "t2", "t3").alias("last_target"), sig.opacity(F.col("mfe_atr") / 2).alias("opacity")))


@query("a07_entry_quality_by_side", ORACLE_SQL["b22_entry_quality"].replace("SELECT symbol, ts_s, range_id, level,", "SELECT direction, level, count(*) AS n,").replace("round(mfe, 6) + 0.0 AS mfe", "round(avg(mfe), 5) + 0.0 AS mfe").replace("round(mae, 6) + 0.0 AS mae", "round(avg(mae), 5) + 0.0 AS mae")
       .split(", round(CASE WHEN mfe IS NOT NULL")[0] + " FROM m GROUP BY ALL")
def a07(spark, d):
    w = _walked(spark, d)
    rows = backtest.entry_quality(indicators.atr(w), profile.touches(w, _weekly_levels(spark, d, lambda: w)))
    return rounded(rows.groupBy("direction", "level").agg(F.count("*").alias("n"), F.avg("mfe").alias("mfe"), F.avg("mae").alias("mae")), 5)


@query("f_structure_gate", _walk(_LEVEL_SQL, _TOUCH_SQL) + """, t AS (SELECT CASE abs(ts_s // 3600) % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'undefined' END AS regime, direction AS d FROM touch)
  SELECT regime, d AS direction, (regime = 'bullish' AND d > 0) OR (regime = 'bearish' AND d < 0) AS with_trend, NOT ((regime = 'bullish' AND d < 0) OR (regime = 'bearish' AND d > 0)) AS not_against, count(*) AS n FROM t GROUP BY ALL""")
def f_gate(spark, d):
    w = _walked(spark, d)
    t = profile.touches(w, _weekly_levels(spark, d, lambda: w))
    k = F.floor(F.unix_seconds("ts") / 3600) % 3
    t = t.withColumn("regime", F.when(k == 0, "bullish").when(k == 1, "bearish").otherwise("undefined"))
    return t.groupBy("regime", "direction", sig.permitted("regime", "direction", "with").alias("with_trend"), sig.permitted("regime", "direction", "not_against").alias("not_against")).agg(F.count("*").alias("n"))


@query("f8_spans_in_view", _walk(_SPANS_SQL) + """ SELECT range_id FROM spans WHERE epoch("end") >= 1705276800 AND epoch("start") <= 1705449600""")
def f8(spark, d):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    return profile.in_view(_spans(spark, d), at(_AT), at(_AT + 172_800)).select("range_id")


@query("f9_halves", f"WITH {SQL_TRADES}, d AS (SELECT DISTINCT exit_ts FROM trades), cut AS (SELECT list_sort(list(exit_ts))[count(*) // 2 + 1] AS cut FROM d) SELECT CASE WHEN exit_ts <= cut THEN 'h1' ELSE 'h2' END AS half, count(*) AS n, round(avg(pnl_r), 6) AS mean_r FROM trades, cut GROUP BY ALL")
def f9(spark, d):
    t = v.trades(spark, d).withColumnRenamed("exit_ts", "entry_ts").withColumn("symbol", F.lit("ALL"))
    t = backtest.halves(t, t.select("symbol", F.col("entry_ts").alias("ts")).distinct())  # days with trades are the history
    return rounded(t.groupBy("half").agg(F.count("*").alias("n"), F.avg("pnl_r").alias("mean_r")))


# metrics


@query("a13_capture", f"WITH {SQL_TRADES} SELECT round(avg(pnl_r), 6) AS mean_r, round(avg(mfe_atr / 1.5), 6) AS offered_r, round(avg(pnl_r) / avg(mfe_atr / 1.5), 6) AS captured FROM trades")
def a13(spark, d):
    return rounded(metrics.capture(v.trades(spark, d).withColumn("mfe_r", F.col("mfe_atr") / 1.5)))


@query("a01_trade_summary", f"WITH {SQL_TRADES}, dd AS (SELECT *, greatest(10000.0, max(capital_after) OVER (ORDER BY seq)) AS peak FROM trades) SELECT count(*) AS n_trades, round(avg(CASE WHEN pnl_pct > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate,"
  " round(arg_max(capital_after, seq) / 10000.0 - 1, 6) AS total_return, round(avg(pnl_r), 6) AS mean_r, round(median(pnl_r), 6) AS median_r, round(sum(pnl_r), 6) AS total_r, round(sum(CASE WHEN pnl_pct > 0 THEN pnl_pct END) / sum(CASE WHEN pnl_pct < 0 THEN -pnl_pct END), 6) AS profit_factor,"
  " round(min(least(0, (capital_after - peak) / peak)), 6) AS max_drawdown, round(avg(mae_pct), 6) AS mean_mae, round(avg(mfe_pct), 6) AS mean_mfe, round(median(bars) * 0.25, 6) AS median_hours FROM dd")
def a01(spark, d):
    return rounded(metrics.summary(v.trades(spark, d), 10_000.0))


def _breakdown_sql(*by: str) -> str:
    return f"WITH {SQL_TRADES} SELECT {', '.join(by)}, count(*) AS n_trades, round(avg(CASE WHEN pnl_pct > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate, round(avg(pnl_r), 6) AS mean_r, round(sum(pnl_r), 6) AS total_r FROM trades GROUP BY ALL"


@query("a03_breakdown_by_score", _breakdown_sql("score::DOUBLE AS score"))
def a03(spark, d):
    return rounded(metrics.breakdown(v.trades(spark, d).withColumn("score", F.col("score").cast("double")), "score"))


@query("a05_breakdown_by_level_and_side", _breakdown_sql("level", "direction"))
def a05(spark, d):
    return rounded(metrics.breakdown(v.trades(spark, d), "level", "direction"))


@query("a04_breakdown_by_year", _breakdown_sql("CAST(year(exit_ts) AS INTEGER) AS year"))
def a04(spark, d):
    return rounded(metrics.by_year(v.trades(spark, d)))


@query("a06_group_median", f"WITH {SQL_TRADES} SELECT level, count(*) AS n, round(median(bars), 6) AS median_bars, round(median(pnl_r), 6) AS median_r FROM trades GROUP BY level")
def a06(spark, d):
    t = v.trades(spark, d)
    middle = metrics.quantiles(t, {"median_bars": ("bars", 0.5), "median_r": ("pnl_r", 0.5)}, ("level",))
    return rounded(t.groupBy("level").agg(F.count("*").alias("n")).join(middle, "level"))


@query("a08_threshold_shares", f"WITH {SQL_TRADES} SELECT " + ", ".join(f"round(avg(CASE WHEN mfe_atr / 1.5 >= {m} THEN 1.0::DOUBLE ELSE 0 END), 6) AS reached_{str(m).replace('.', '_')}" for m in (0.5, 1, 1.5, 2, 3)) + " FROM trades")
def a08(spark, d):
    return rounded(metrics.threshold_shares(v.trades(spark, d)))


@query("a09_acceptance", f"WITH {SQL_TRADES} SELECT 'high score' AS label, count(*) AS n, round(avg(pnl_r), 6) AS mean_r, round(avg(CASE WHEN pnl_r > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate, round(sum(CASE WHEN pnl_r > 0 THEN pnl_r END) / sum(CASE WHEN pnl_r < 0 THEN -pnl_r END), 6) AS profit_factor FROM trades WHERE score >= 3")
def a09(spark, d):
    return rounded(metrics.acceptance(v.trades(spark, d).withColumn("ok", F.col("score") >= 3), "ok", "high score"))


@query("a10_weighted_metrics", f"WITH {SQL_TRADES}, w AS (SELECT *, (coalesce(score, 0) + 1.0::DOUBLE) AS wt FROM trades), n AS (SELECT *, pnl_r * wt / avg(wt) OVER () AS r, wt / avg(wt) OVER () AS nw FROM w) SELECT round(avg(r), 6) AS mean_r, round(sum(CASE WHEN r > 0 THEN r END) / sum(CASE WHEN r < 0 THEN -r END), 6) AS profit_factor, round(avg(CASE WHEN pnl_r > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate, round(max(nw), 6) AS max_weight FROM n")
def a10(spark, d):
    return rounded(metrics.weighted(v.trades(spark, d).withColumn("wt", F.coalesce(F.col("score"), F.lit(0)) + 1.0), "wt"))


@query("a11_control_summary", f"WITH {SQL_TRADES}, c AS (SELECT seq % 20 AS run, avg(pnl_r) AS mean_r FROM trades GROUP BY 1) SELECT count(*) AS n_runs, round(avg(mean_r), 6) AS mean, round(min(mean_r), 6) AS least, round(max(mean_r), 6) AS most, CAST(sum(CASE WHEN mean_r >= 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS n_reaching FROM c")
def a11(spark, d):
    runs = v.trades(spark, d).groupBy((F.col("seq") % 20).alias("run")).agg(F.avg("pnl_r").alias("mean_r"))
    return rounded(metrics.control_summary(runs, 0.1))


def _poisson_steps() -> list[float]:
    steps, total, p = [], 0.0, 2.718281828459045**-1
    for k in range(8):
        total += p
        steps.append(total)
        p /= k + 1
    return steps


_TIMES = " + ".join(f"CASE WHEN u >= {x!r}::DOUBLE THEN 1 ELSE 0 END" for x in _poisson_steps())


@query("a12_resampled_means", f"WITH {SQL_TRADES}, drawn AS (SELECT run, pnl_r, CAST('0x' || substr(md5('7/' || run || '/' || seq), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM trades, (SELECT unnest(generate_series(1, 50))::INTEGER AS run) r),"
       f" c AS (SELECT run, pnl_r, {_TIMES} AS times FROM drawn) SELECT run, round(sum(pnl_r * times) / sum(times), 6) AS mean_value FROM c GROUP BY run")
def a12(spark, d):
    return rounded(metrics.resampled(v.trades(spark, d), 50))


@query("a14_worst_part", f"WITH {SQL_TRADES}, p AS (SELECT level, direction, count(*) AS n, avg(pnl_r) AS r FROM trades GROUP BY ALL) SELECT level, round(min(r), 6) AS worst, CAST(sum(n) AS BIGINT) AS n_trades, bool_and(n >= 15) AS valid FROM p GROUP BY level")
def a14(spark, d):
    parts = metrics.breakdown(v.trades(spark, d), "level", "direction")
    return rounded(metrics.worst_of(parts, ["level"]))


@query("a19_quantile_threshold", f"WITH {SQL_TRADES} SELECT round(quantile_cont(pnl_r, 0.7), 6) AS threshold, CAST(count(DISTINCT level) AS BIGINT) AS n_levels FROM trades")
def a19(spark, d):
    t = v.trades(spark, d)
    return rounded(metrics.quantiles(t, {"threshold": ("pnl_r", 0.7)}).join(F.broadcast(t.agg(F.count_distinct("level").alias("n_levels")))))  # one row each


# signals

_SIG_SQL = """sg AS (SELECT seq, CASE WHEN direction = 'long' THEN 1 ELSE -1 END AS d, level, bars % 3 / 1.5 AS impulse, CASE bars % 4 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE '' END AS divergence,
  CASE bars % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'undefined' END AS regime, bars % 5 AS confluence, bars % 100 AS stochastic, CASE bars % 3 WHEN 0 THEN 'bullish_strong' WHEN 1 THEN 'bearish_weak' ELSE '' END AS ttm_phase FROM trades),
  s AS (SELECT seq, impulse >= 1 AS a, (divergence = 'bullish' AND d > 0) OR (divergence = 'bearish' AND d < 0) AS b, NOT ((level = 'vah' AND d < 0) OR (level = 'val' AND d > 0)) AS c,
    NOT ((regime = 'bullish' AND d > 0) OR (regime = 'bearish' AND d < 0)) AS e, confluence < 2 AS f, CASE WHEN d > 0 THEN stochastic <= 20 ELSE stochastic >= 80 END AS g, ends_with(ttm_phase, 'strong') AS h FROM sg)"""


@query("f_signals_and_score", f"WITH {SQL_TRADES}, {_SIG_SQL} SELECT seq, (a::INT + b::INT + c::INT + e::INT + f::INT + h::INT) AS score, array_to_string(list_filter([CASE WHEN a THEN 'impulse' END, CASE WHEN b THEN 'divergence' END, CASE WHEN c THEN 'rotation' END, CASE WHEN e THEN 'counter_structure' END, CASE WHEN f THEN 'low_confluence' END, CASE WHEN g THEN 'stochastic' END, CASE WHEN h THEN 'ttm_phase' END], lambda x: x IS NOT NULL), '+') AS signals FROM s")
def f_signals(spark, d):
    b = F.col("bars")
    t = v.trades(spark, d).select(
        "seq", "level", F.when(F.col("direction") == "long", 1).otherwise(-1).alias("direction"), (b % 3 / 1.5).alias("impulse"), F.when(b % 4 == 0, "bullish").when(b % 4 == 1, "bearish").otherwise("").alias("divergence"),
        F.when(b % 3 == 0, "bullish").when(b % 3 == 1, "bearish").otherwise("undefined").alias("regime"), (b % 5).alias("confluence"), (b % 100).alias("stochastic"), F.when(b % 3 == 0, "bullish_strong").when(b % 3 == 1, "bearish_weak").otherwise("").alias("ttm_phase"),
    )
    s = sig.active_signals()
    return t.select("seq", sig.score(s, ("ttm_phase",)).alias("score"), sig.joined_names(s).alias("signals"))


@query("f_multipliers", f"WITH {SQL_TRADES} SELECT seq, round(least(2.0, greatest(0.5, 1 + 12.0 * (pnl_r - 0.3))), 6) AS multiplier, round(-pnl_pct * CASE WHEN direction = 'long' THEN 1 ELSE -1 END, 6) + 0.0 AS oriented FROM trades")
def f_multipliers(spark, d):
    side = F.when(F.col("direction") == "long", 1).otherwise(-1)
    return rounded(v.trades(spark, d).select("seq", sig.learned_multiplier("pnl_r", 0.3).alias("multiplier"), sig.oriented_funding("pnl_pct", side).alias("oriented")))


# learning and streaming


@query("m01_trade_sample")
def m01(spark, d):
    from ..operators import learning

    w = v.walk(spark, d)
    trades = _simulated(spark, d, _weekly_levels(spark, d), config=BacktestConfig(max_adx=None, avoid_squeeze=False, min_impulse=None))
    return rounded(learning.sample(trades, backtest.features(w, SIMULATION), BacktestConfig()))


@query("m02_logistic_filter")
def m02(spark, d):
    from ..operators import learning

    rows = store.written(QUERIES["m01_trade_sample"](spark, d))
    train, test = learning.ordered_split(rows)
    model = learning.logistic(train.count()).fit(train)
    mark = learning.threshold(learning.probabilities(model, train), 0.5)
    judged = learning.probabilities(model, test).withColumn("ok", F.col("probability") >= mark)
    return rounded(metrics.acceptance(judged, "ok", "logistic").unionByName(metrics.acceptance(judged.withColumn("all", F.lit(True)), "all", "unfiltered")))


@query("m03_boosted_filter")
def m03(spark, d):
    from ..operators import learning

    train, test = learning.ordered_split(store.written(QUERIES["m01_trade_sample"](spark, d)))
    return rounded(learning.evaluated(train, test, learning.boosted(rounds=20, leaf=5), "boosted"))


@query("m05_crossed_assets")
def m05(spark, d):
    from ..operators import learning

    # two walks, of two groups of events, are two symbols in one pass
    walks = lambda step=HOUR: v.two_walks(spark, d, step)
    levels = _weekly_levels(spark, d, walks)
    trades = _simulated(spark, d, levels, config=BacktestConfig(max_adx=None, avoid_squeeze=False, min_impulse=None), walks=walks)
    rows = store.written(learning.sample(trades, backtest.features(store.written(walks()), SIMULATION), BacktestConfig()))
    return rounded(learning.crossed(rows, [("CLICKS", "OTHERS"), ("OTHERS", "CLICKS")]))


@query("m06_coefficients")
def m06(spark, d):
    from ..operators import learning

    rows = store.written(QUERIES["m01_trade_sample"](spark, d))
    return rounded(learning.coefficients(learning.logistic(rows.count()).fit(rows), spark))


@query("m07_walk_forward_sizing")
def m07(spark, d):
    from ..operators import learning

    rows = store.written(QUERIES["m01_trade_sample"](spark, d))
    sized = learning.walk_forward(rows, 40, 20)
    return rounded(metrics.weighted(sized, "multiplier"))


@query("st01_streamed_candles", "WITH " + SQL_BARS.replace("1 HOUR", "4 HOUR") + "SELECT symbol, epoch(ts)::BIGINT AS ts_s, open, high, low, close, volume FROM bars WHERE ts + INTERVAL 4 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def st01(spark, d):
    import os

    from ..streaming.candles import run_available

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{os.path.dirname(d + '/x')}/events.parquet*")
    ticks = raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))
    return _shown(run_available(spark, ticks, 4 * HOUR), "open", "high", "low", "close", "volume")


def _streamed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` as a stream of the files of a table in the shared folder."""
    path = store.shared_path(spark, "feed")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query("st02_streamed_gaps", f"SELECT * FROM ({ORACLE_SQL['i02_gap_evolution']}) WHERE ts_s <= (WITH {SQL_WALK_TICKS} SELECT time_bucket(INTERVAL 1 HOUR, max(ts)).epoch() - 3600 FROM walk_ticks)")
def st02(spark, d):
    from ..streaming import ordered

    return _shown(ordered.run(spark, ordered.stream_gaps(_streamed(spark, v.walk(spark, d)), HOUR)), "gap_id", "edge", "alive")


@query("st03_streamed_funding", _walk(SQL_RATES) + """, closed AS (SELECT least((SELECT max(ts) FROM walk), (SELECT max(ts) FROM rates)) - INTERVAL 1 HOUR - INTERVAL 2 DAY AS t)
  SELECT w.symbol, epoch(w.ts)::BIGINT AS ts_s, CASE WHEN r.ts > w.ts - INTERVAL 2 DAY THEN round(r.funding, 6) END AS funding FROM walk w ASOF LEFT JOIN rates r ON w.symbol = r.symbol AND w.ts >= r.ts WHERE w.ts + INTERVAL 1 SECOND <= (SELECT t FROM closed)""")
def st03(spark, d):
    from ..streaming import ordered

    walked, paid = _streamed(spark, v.walk(spark, d).select("symbol", "ts")), _streamed(spark, v.rates(spark, d))
    return _shown(ordered.run(spark, ordered.stream_asof(walked, paid, ["funding"], "2 DAYS")), "funding")


@query("st04_streamed_pivots", _bars(_PIVOT_SQL) + f" SELECT {OUT}, pivot_high, pivot_low FROM (SELECT *, lead(ts, 3) OVER (PARTITION BY symbol ORDER BY ts) AS known FROM piv) WHERE epoch(known) <= (SELECT epoch(max(ts)) - 3600 FROM bars)")
def st04(spark, d):
    from ..streaming import ordered

    return _shown(ordered.run(spark, ordered.stream_pivots(_streamed(spark, v.bars(spark, d)))), "pivot_high", "pivot_low")
