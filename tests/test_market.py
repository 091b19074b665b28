"""Operators on small series with known answers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from helpers import BASE, at, bars, column
from pyspark.sql import functions as F

from tapeweave.config import BacktestConfig, RangeConfig, RangeWindow, from_yaml
from tapeweave.operators import asof, backtest, gaps, indicators, metrics, profile, quality, ranges, structure
from tapeweave.schema import require_columns
from tapeweave.sources import candles, store


def test_ewm_equals_pandas(spark):
    x = np.random.default_rng(1).normal(100, 5, 900)
    got = column(indicators.ewm(bars(spark, x), "close", 1 / 14, "y"), "y")
    assert np.allclose(got, pd.Series(x).ewm(alpha=1 / 14, adjust=False).mean(), rtol=0, atol=1e-9)
    got = column(indicators.ewm(bars(spark, x), "close", 0.5, "y"), "y")
    assert np.allclose(got, pd.Series(x).ewm(alpha=0.5, adjust=False).mean(), rtol=0, atol=1e-9)


def test_rsi_is_100_on_a_rise_and_on_a_flat_line(spark):
    assert set(column(indicators.rsi(bars(spark, range(100, 130))), "rsi")) == {100.0}
    assert set(column(indicators.rsi(bars(spark, [100] * 20)), "rsi")) == {100.0}


def test_stochastic_is_null_on_a_flat_range(spark):
    flat = bars(spark, [100] * 20, wick=0.0)
    assert set(column(indicators.stochastic(flat), "stochastic")) == {None}


def test_adx_rises_in_a_trend(spark):
    got = column(indicators.adx(bars(spark, [100 + i for i in range(60)])), "adx")
    assert got[0] is None and got[-1] > 90


def test_plateau_is_no_pivot(spark):
    x = [1, 2, 3, 5, 5, 3, 2, 1, 2, 3, 4, 3, 2, 1]
    df = structure.pivots(bars(spark, x))
    assert [i for i, p in enumerate(column(df, "pivot_high")) if p] == [10]


def test_structure_knows_a_pivot_only_after_its_bars(spark):
    x = [3, 2, 1, 0, 1, 2, 3, 4, 5, 4, 3, 2, 3, 4, 5, 6, 7, 8, 7, 6, 5, 6, 7, 8, 9]
    df = structure.market_structure(bars(spark, x, wick=0.1))
    high, regime = column(df, "swing_high"), column(df, "regime")
    assert high[10] is None and high[11] == 5.0
    assert regime[-1] == "bullish" and regime[5] == "undefined"


def test_gap_is_known_after_the_third_bar_and_wicks_wear_it(spark):
    low, high = [10, 10, 14, 13, 11, 9, 12], [11, 13, 16, 15, 14, 12, 13]
    c = bars(spark, [10.5, 12, 15, 14, 13, 10, 12.5], highs=high, lows=low)
    g = gaps.detect(c, 4 * 3600).where("kind = 'bullish'")
    row = g.first()
    assert (row.top, row.bottom, row.confirmed_at) == (14.0, 11.0, at(3))
    path = gaps.evolution(g, c).orderBy("ts").collect()
    assert [(r.edge, r.alive) for r in path] == [(13.0, True), (11.0, False)]
    assert gaps.alive_at(g, c, F.lit(at(3))).first().top == 13.0
    assert gaps.alive_at(g, c, F.lit(at(5))).count() == 0


def test_truncation_leaves_the_past_alone(spark):
    rng = np.random.default_rng(5)
    x = 100 + np.cumsum(rng.normal(0, 1, 300))
    for build, col in ((lambda d: indicators.squeeze(d), "squeeze_bars"), (lambda d: structure.market_structure(d), "regime"), (lambda d: structure.divergences(indicators.macd(d), "histogram"), "divergence")):
        whole = column(build(bars(spark, x)), col)
        assert column(build(bars(spark, x[:210])), col) == whole[:210]


def test_asof_sees_a_payment_only_from_its_time_on(spark):
    c = bars(spark, [1, 2, 3, 4])
    pay = spark.createDataFrame([("X", at(2), 0.5)], "symbol string, ts timestamp, funding double")
    assert column(asof.asof(c, pay, ["funding"]), "funding") == [None, None, 0.5, 0.5]
    assert column(asof.asof(c, pay, ["funding"], strict=True), "funding") == [None, None, None, 0.5]
    assert column(asof.asof(c, pay, ["funding"], delay=4 * 3600), "funding") == [None, None, None, 0.5]
    assert column(asof.asof(c, pay, ["funding"], block=4 * 3600), "funding") == [None, None, 0.5, 0.5]


def test_cumulative_over_blocks(spark):
    df = spark.range(100).select(F.col("id").alias("i"), (F.col("id") % 7).alias("v"))
    got = candles.cumulative(df, "v", "s", F.floor(F.col("i") / 9), ["i"]).orderBy("i").collect()
    assert [r.s for r in got] == list(np.cumsum([i % 7 for i in range(100)]))


def test_landing_keeps_the_first_and_drops_the_open_bar(spark):
    c = bars(spark, [1, 2, 3]).withColumn("arrival", F.lit(1))
    raw = c.unionByName(c.where("close = 2").withColumns({"close": F.lit(9.0), "arrival": F.lit(2)}))
    got = candles.landed(raw, 4 * 3600, F.lit(at(2))).orderBy("ts").collect()
    assert [r.close for r in got] == [1.0, 2.0]


def test_storage_round_trip(spark, tmp_path):
    c = bars(spark, [1, 2, 3], symbol="A/B:C")
    store.write_candles(c, f"{tmp_path}/t", "4h")
    assert store.read_candles(spark, f"{tmp_path}/t", ["A/B:C"], ["4h"]).count() == 3
    assert store.read_candles(spark, f"{tmp_path}/t", ["other"]).count() == 0
    two = bars(spark, [1], symbol="B/C").unionByName(bars(spark, [2, 3], symbol="B-C"))
    store.write_candles(two, f"{tmp_path}/t", "4h")
    assert store.read_candles(spark, f"{tmp_path}/t", ["B/C"]).count() == 1
    listed = store.read_watchlist(spark, f"{tmp_path}/t", ["B-C", "A/B:C", "B-C", "none"], ["4h", "1h", "4h"]).groupBy("symbol", "tf", "place").agg(F.count("ts").alias("n")).orderBy("place").collect()
    assert [(r.symbol, r.tf, r.n) for r in listed] == [("B-C", "4h", 2), ("B-C", "1h", 0), ("A/B:C", "4h", 3), ("A/B:C", "1h", 0), ("none", "4h", 0), ("none", "1h", 0)]
    made = []
    make = lambda: made.append(1) or c
    assert store.read_through(spark, f"{tmp_path}/r", make).count() == 3 == store.read_through(spark, f"{tmp_path}/r", make).count()
    assert len(made) == 1


def test_checks_raise(spark, tmp_path):
    with pytest.raises(KeyError):
        require_columns(bars(spark, [1]), "nothing")
    with pytest.raises(ValueError):
        RangeConfig(windows=())
    with pytest.raises(ValueError):
        BacktestConfig(selection="sometimes")
    bad = spark.createDataFrame([("X", BASE, 0.5)], "symbol string, ts timestamp, funding double")
    with pytest.raises(ValueError):
        quality.require_valid_funding(bad)
    with pytest.raises(Exception, match="no translation"):
        store.translated(bars(spark, [1]), {"Y": "y"}).collect()
    (tmp_path / "c.yaml").write_text("windows:\n - {bars: 30, kind: primary}\nmin_crossings: 2\n")
    assert from_yaml(f"{tmp_path}/c.yaml", RangeConfig).windows == (RangeWindow(30, "primary"),)
    (tmp_path / "d.yaml").write_text("nonsense: 1\n")
    with pytest.raises(KeyError):
        from_yaml(f"{tmp_path}/d.yaml", RangeConfig)


WAVE = RangeConfig(windows=(RangeWindow(60, "primary"),), max_height_atr=40.0, min_crossings=5, min_quality={"primary": 0.0})


def test_a_wave_is_a_range_and_a_trend_is_none(spark):
    x = [100 + 5 * math.sin(2 * math.pi * i / 12) for i in range(120)] + [140 + i for i in range(20)]
    got = ranges.detect(bars(spark, x), WAVE).collect()
    assert len(got) == 1
    r = got[0]
    assert abs(r.ceiling - 105) < 0.1 and abs(r.floor - 95) < 0.1 and not r.open_ended
    assert r.confirmed_at == at(124) and r.containment == 1.0 and r.crossings >= 8
    assert ranges.detect(bars(spark, [100 + i for i in range(200)]), WAVE).count() == 0


def test_open_range_and_one_bar_outside(spark):
    x = [100 + 5 * math.sin(2 * math.pi * i / 12) for i in range(150)]
    x[100] = 120
    r = ranges.detect(bars(spark, x), WAVE).collect()
    assert len(r) == 1 and r[0].open_ended and r[0].confirmed_at is None


def test_selection_is_greedy_by_quality_and_duration(spark):
    rows = [("X", w, "primary", at(a), at(b), q, at(b), at(b)) for w, a, b, q in ((60, 0, 100, 0.9), (150, 50, 140, 0.95), (250, 101, 200, 0.5), (400, 300, 400, 0.3))]
    df = spark.createDataFrame(rows, "symbol string, window int, kind string, start timestamp, end timestamp, quality double, declared_at timestamp, confirmed_at timestamp")
    c = RangeConfig()
    assert {r.window for r in ranges.select(df, c).collect()} == {60, 250}
    assert {r.window for r in ranges.select_causally(df, c).collect()} == {60, 250}


def test_profile_of_two_candles(spark):
    c = bars(spark, [1, 3], highs=[2, 4], lows=[0, 2], wick=0)
    span = spark.createDataFrame([("r", "X", at(0), at(1))], "range_id string, symbol string, start timestamp, end timestamp")
    from tapeweave.config import ProfileConfig

    p = profile.profiles(c, span, ProfileConfig(bins=4)).first()
    assert p.volumes == [0.5, 0.5, 0.5, 0.5] and p.volume_total == 2.0
    assert (p.poc, p.val, p.vah) == (1.5, 1.0, 4.0)


def _trade(spark, path, levels, zones=None, **settings):
    """Trades over 15-minute (open, high, low, close) bars, four to a decision bar."""
    c = BacktestConfig(**{"maker_fee": 0.0, "taker_fee": 0.0, "slippage": 0.0, "stop_atr": 1.0, "max_adx": None, "avoid_squeeze": False, "min_impulse": None, **settings})
    made = []
    for i in range(0, len(path), 4):
        fine = [(at(j, 0.25), *map(float, path[j])) for j in range(i, min(i + 4, len(path)))]
        made.append(("X", i // 4, at(i // 4, 1), fine[-1][4], 1.0, 2.0, 20.0, False, 50.0, "", "", "undefined", fine, zones or []))
    bars_ = spark.createDataFrame(made, "symbol string, pos long, ts timestamp, close double, atr double, impulse double, adx double, squeeze boolean, stochastic double, ttm_phase string, standing string, regime string, fine array<struct<ts:timestamp,open:double,high:double,low:double,close:double>>, zones array<double>")
    lv = spark.createDataFrame([("X", "r", n, p, 0.5, at(v, 1)) for n, p, v in levels], "symbol string, range_id string, level string, price double, quality double, valid_from timestamp")
    return [r.asDict() for r in backtest.simulate(bars_, lv, c).orderBy("seq").collect()]


FLAT = [(105, 105.2, 104.8, 105)] * 4


def test_stop_wins_over_target_in_one_bar(spark):
    path = FLAT + [(104, 104.5, 99.9, 100.2), (100, 120, 90, 100)] + FLAT
    t = _trade(spark, path, [("poc", 100.0, 0)])
    assert len(t) == 1 and t[0]["exit_reason"] == "stop" and abs(t[0]["pnl_r"] + 1) < 1e-9 and t[0]["bars"] == 1


def test_a_gap_through_the_stop_costs_more(spark):
    path = FLAT + [(104, 104.5, 99.9, 100.2), (95, 96, 94, 95), *FLAT[:2]]
    assert abs(_trade(spark, path, [("poc", 100.0, 0)])[0]["pnl_pct"] + 0.05) < 1e-9


def test_level_is_not_filled_before_it_is_valid_nor_twice_in_the_cooldown(spark):
    dip = [(104, 104.5, 99.9, 104), (104, 104, 104, 104), (104, 104, 98, 104), (104, 104, 104, 105)]
    assert _trade(spark, FLAT + dip + FLAT, [("poc", 100.0, 3)]) == []
    assert len(_trade(spark, FLAT + dip + dip + FLAT, [("poc", 100.0, 0)])) == 1
    assert len(_trade(spark, FLAT + dip + dip + FLAT, [("poc", 100.0, 0)], cooldown=1)) == 2


def test_targets_break_even_and_end(spark):
    rise = [(101, 101.2, 100.5, 101), (102, 102.5, 101, 102), (103, 103.5, 102.5, 103), (103, 103, 102.8, 103)]
    path = FLAT + [(104, 104.5, 99.9, 100.2), (100.2, 100.4, 100.1, 100.3)] + [(100.3, 100.4, 100.1, 100.3)] * 2 + rise + [(103, 103, 99, 99)] * 4
    t = _trade(spark, path, [("poc", 100.0, 0)], zones=[101.0, 102.0, 110.0], first_target_max_atr=None)[0]
    assert t["targets_reached"] == 2 and t["exit_reason"] == "break_even" and t["pnl_pct"] > 0
    t = _trade(spark, FLAT + [(104, 104.5, 99.9, 100.2)] + [(100.2, 100.4, 100.1, 100.3)] * 3, [("poc", 100.0, 0)])[0]
    assert t["exit_reason"] == "end_of_data"


def _plan(spark, entry, side, grid, atr, **settings):
    df = spark.createDataFrame([(entry, side, grid, atr)], "e double, s int, g array<double>, a double")
    return df.select(backtest.exit_plan(*(F.col(x) for x in "esga"), BacktestConfig(**settings)).alias("p")).first().p


@pytest.mark.parametrize(("entry", "side", "grid", "settings", "targets", "shares", "stop", "fallback"), [
    (100.0, 1, [], {}, [105, 110.25, 115.7625], [0.3333, 0.3333, 0.3334], 98.5, True),
    (100.0, -1, [], {"fallback_ladder": False, "fallback_stop_is_atr": False}, [95], [1.0], 102.0, True),
    (100.0, 1, [103.0, 120.0], {}, [101.0, 108.15], [0.3333, 0.6667], 98.5, False),
    (100.0, -1, [97.0], {}, [99.0, 95.0], [0.3333, 0.6667], 101.5, False),
    (100.0, 1, [100.6, 104.9], {"first_target_beyond_stop": False, "first_target_max_atr": None, "max_target_distance": None}, [100.6, 104.9], [0.3333, 0.6667], 98.5, False),
    (100.0, 1, [103.0, 110.0, 130.0], {"max_target_r": 3.0, "first_target_max_atr": None, "max_target_distance": None}, [103.0, 104.5], [0.3333, 0.6667], 98.5, False),
    (100.0, 1, [120.0], {"cap_from_entry": True, "first_target_max_atr": None}, [105.0], [1.0], 98.5, False),
    (100.0, 1, [103.0], {"targets_in_r": (1.0, 2.0)}, [101.5, 103.0], [0.3333, 0.3333], 98.5, False),
    (100.0, 1, [103.0], {"first_target_max_atr": None, "first_target_max_pct": 0.02}, [102.0, 105.0], [0.3333, 0.6667], 98.5, False),
])
def test_each_rule_of_the_exit_plan(spark, entry, side, grid, settings, targets, shares, stop, fallback):
    p = _plan(spark, entry, side, grid, 1.0, **settings)
    assert np.allclose(p.targets, targets) and np.allclose(p.shares, shares) and abs(p.stop - stop) < 1e-9 and p.fallback == fallback


def test_timeout_rejection_and_note(spark):
    dip = [(104, 104.5, 99.9, 100.2), (100.2, 100.4, 100.1, 100.3), (100.3, 100.4, 100.1, 100.3), (100.3, 100.4, 100.1, 100.3)]
    t = _trade(spark, FLAT + dip + dip[1:] * 4, [("poc", 100.0, 0)], timeout_bars=1, first_target_max_atr=None)[0]
    assert t["exit_reason"] == "timeout" and t["bars"] == 4
    assert _trade(spark, FLAT + dip + FLAT, [("poc", 100.0, 0)], min_rejection=0.5) == []
    t = _trade(spark, FLAT + dip + FLAT, [("poc", 100.0, 0)], min_rejection=0.04)[0]
    assert t["entry"] == 100.2 and abs(t["initial_stop"] - 99.2) < 1e-9
    assert _trade(spark, FLAT + dip + FLAT, [("poc", 100.0, 0)], min_note=0.9) == []
    assert t["confluence"] == 1 and 0 < t["quality"] < 1


def test_target_picking(spark):
    df = spark.createDataFrame([(100.0, 1, [100.2, 103.0, 103.1, 110.0, 99.0, None]), (100.0, -1, [99.9, 97.0, 96.9, 90.0])], "entry double, side int, grid array<double>")
    got = df.select(profile.pick_targets(F.col("entry"), F.col("side"), F.col("grid"), 0.005, 3).alias("t")).collect()
    assert [r.t for r in got] == [[103.0, 110.0], [97.0, 90.0]]


def test_summary_defaults_and_infinite_profit_factor(spark):
    schema = "seq long, pnl_pct double, pnl_r double, capital_after double, mae_pct double, mfe_pct double, bars int"
    none = metrics.summary(spark.createDataFrame([], schema), 100.0).first()
    assert none.n_trades == 0 and none.total_return == 0.0 and none.max_drawdown == 0.0 and none.profit_factor is None
    one = metrics.summary(spark.createDataFrame([(1, 0.1, 1.0, 110.0, 0.0, 0.1, 4), (2, 0.0, 0.0, 99.0, 0.0, 0.1, 8)], schema), 100.0).first()
    assert one.profit_factor == math.inf and abs(one.max_drawdown + 0.1) < 1e-12 and one.median_hours == 1.5


def test_equal_levels_and_bars_give_equal_trades_in_spark(spark):
    x = [100 + 4 * math.sin(i / 3) for i in range(200)]
    fine = bars(spark, [c for c in x for _ in range(4)], hours=1)
    coarse = candles.resample(fine, 4 * 3600)
    c = BacktestConfig(max_adx=None, avoid_squeeze=False, min_impulse=None)
    decided = backtest.decision_bars(backtest.features(coarse, c), fine, 4 * 3600)
    levels = spark.createDataFrame([("X", "r", "poc", 100.0, 0.5, at(20)), ("X", "r", "val", 98.0, 0.5, at(20))], "symbol string, range_id string, level string, price double, quality double, valid_from timestamp")
    two = levels.withColumn("scenario", F.explode(F.array(F.lit("a"), F.lit("b"))))
    got = backtest.simulate(decided, two, c).toPandas().drop(columns="scenario")
    assert len(got) > 2 and (got.entry_ts >= pd.Timestamp(at(20))).all()
    assert len(got.drop_duplicates()) * 2 == len(got)
    assert backtest.simulate(decided, levels.limit(0), c).count() == 0


def test_quantiles_equal_numpy_with_ties_nulls_and_a_null_group(spark):
    rng = np.random.default_rng(5)
    values = {"a": rng.normal(size=3001), "b": rng.integers(0, 3, 700).astype(float), None: np.array([2.0, 1.0]), "one": np.array([4.0])}
    data = [(g, float(x)) for g, xs in values.items() for x in xs] + [("none", None), ("a", None)]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    got = {r.g: r for r in metrics.quantiles(df, {"mid": ("x", 0.5), "high": ("x", 0.7), "most": ("x", 1.0)}, ("g",)).collect()}
    assert set(got) == {*values, "none"} and got["none"].mid is None
    for g, xs in values.items():
        assert np.allclose([got[g].mid, got[g].high, got[g].most], np.quantile(xs, [0.5, 0.7, 1.0]), atol=1e-12)
    whole = metrics.quantiles(df, {"mid": ("x", 0.5)}).collect()
    assert len(whole) == 1 and abs(whole[0].mid - np.median(np.concatenate(list(values.values())))) < 1e-12
    assert [r.mid for r in metrics.quantiles(df.limit(0), {"mid": ("x", 0.5)}).collect()] == [None]


def test_gaps_over_many_blocks_equal_a_bar_by_bar_version(spark, monkeypatch):
    monkeypatch.setattr(gaps, "BLOCK", 3)
    rng = np.random.default_rng(2)
    c = bars(spark, list(100 + np.cumsum(rng.normal(size=150))), wick=0.3)
    g = gaps.detect(c, 4 * 3600)
    want, series = set(), c.orderBy("ts").collect()
    for gap in g.collect():
        edge = gap.top if gap.kind == "bullish" else gap.bottom
        for bar in (b for b in series if b.ts >= gap.confirmed_at):
            edge = max(gap.bottom, min(edge, bar.low)) if gap.kind == "bullish" else min(gap.top, max(edge, bar.high))
            dead = edge <= gap.bottom if gap.kind == "bullish" else edge >= gap.top
            want.add((gap.gap_id, bar.ts, edge, not dead))
            if dead:
                break
    got = [(r.gap_id, r.ts, r.edge, r.alive) for r in gaps.evolution(g, c).collect()]
    assert len(want) > 500 and len(got) == len(want) and set(got) == want


def test_summary_by_group_has_the_columns_and_values_of_the_whole(spark):
    schema = "scenario string, seq long, pnl_pct double, pnl_r double, capital_after double, mae_pct double, mfe_pct double, bars int"
    t = spark.createDataFrame([("a", 1, 0.1, 1.0, 110.0, 0.0, 0.1, 4), ("a", 2, -0.1, -1.0, 99.0, 0.2, 0.0, 9), ("a", 3, 0.1, 0.5, 108.9, 0.0, 0.1, 5)], schema)
    whole, parts = metrics.summary(t.drop("scenario"), 100.0), metrics.summary(t, 100.0, ("scenario",))
    assert parts.columns == ["scenario", *whole.columns]
    assert parts.drop("scenario").first() == whole.first()
    assert whole.first().median_r == 0.5 and whole.first().median_hours == 1.25
