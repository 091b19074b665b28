"""Forms that spread over blocks, rounds and events, against plain ones."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from helpers import BASE, at, bars
from pyspark.sql import functions as F

from tapeweave.config import ProfileConfig, RangeConfig
from tapeweave.operators import gaps, indicators, passage, profile, ranges


def test_order_statistics_slide_over_fifty_thousand_bars(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 1, 50_000), 2)  # with many ties
    x[rng.random(50_000) < 0.01] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": pd.date_range("2020-01-01", periods=len(x), freq="h"), "x": x})).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got = indicators.rolling_quantile(indicators.rolling_rank(df, "x", 120, 30, "rank", block=3000), "x", 0.95, 500, 50, "q", block=7000)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    pdf = got.orderBy("ts").toPandas()
    rank = pd.Series(x).rolling(120, min_periods=30).rank(pct=True)
    q = pd.Series(x).rolling(500, min_periods=50).quantile(0.95)
    np.testing.assert_allclose(pdf["rank"].to_numpy(float), rank.where(~np.isnan(x)).to_numpy(), rtol=1e-12)
    np.testing.assert_allclose(pdf["q"].to_numpy(float), q.to_numpy(), rtol=1e-12)


def test_sweep_gives_four_events_a_candle_and_the_volumes_of_every_bin(spark):
    draw = random.Random(2)
    n_bins, rows = 50, []
    for k in range(200):
        low = round(draw.uniform(100, 150), 2)
        high = low if k % 17 == 0 else round(low + draw.choice([0.1, 3, 40]), 2)
        rows.append(("X", at(k), low, high, low, low, float(draw.randrange(5)) if k % 11 else 0.0))
    candles = spark.createDataFrame([(s, t, c, h, lo, c, v) for s, t, lo, h, _, c, v in rows], "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    spans = spark.createDataFrame([("a", "X", at(0), at(120)), ("b", "X", at(60), at(199)), ("flat", "X", at(0), at(0))], "range_id string, symbol string, start timestamp, end timestamp")
    got = profile.volume_by_bin(candles, spans, ProfileConfig(bins=n_bins))
    have = {(r.range_id, r.bin): r.volume for r in got.collect()}
    want = {}
    for name, since, until in (("a", 0, 120), ("b", 60, 199)):
        own = rows[since : until + 1]
        lo, hi = min(r[2] for r in own), max(r[3] for r in own)
        width = (hi - lo) / n_bins
        place = lambda v: max(0, min(n_bins - 1, int((v - lo) // width)))  # noqa: B023, E731
        for _, _, low, high, _, _, volume in own:
            for k in range(place(low), (place(high) if high > low else place(low)) + 1):
                shared = max(0.0, min(high, lo + (k + 1) * width) - max(low, lo + k * width))
                want[name, k] = want.get((name, k), 0.0) + (volume * shared / (high - low) if high > low else volume)
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-9 for k in want)
    # a bin without an event of its own holds exactly what runs through it, nothing if nothing does
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") <= 4


def test_gaps_meet_only_the_bars_of_their_life(spark):
    draw = random.Random(3)
    price, rows = 100.0, []
    for k in range(3000):
        price = max(20.0, price + draw.gauss(0, 1))
        rows.append(("X", at(k), price, price + 0.3, price - 0.3, price, 1.0))
    candles = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    found = gaps.detect(candles, 4 * 3600)
    path = gaps.evolution(found, candles)
    lives = {r.gap_id: r.asDict() for r in found.collect()}
    got = {}
    for r in path.collect():
        got.setdefault(r.gap_id, []).append((r.ts, r.edge, r.alive))
    for name, g in lives.items():
        worn, want = None, []
        for _, ts, _, high, low, *_ in rows:
            if ts < g["confirmed_at"]:
                continue
            wick = low if g["kind"] == "bullish" else high
            worn = wick if worn is None else (min if g["kind"] == "bullish" else max)(worn, wick)
            edge = min(g["top"], max(g["bottom"], worn))
            dead = edge <= g["bottom"] if g["kind"] == "bullish" else edge >= g["top"]
            want.append((ts, edge, not dead))
            if dead:
                break
        assert sorted(got.get(name, [])) == want
    assert len(lives) > 50


def test_pointer_doubling_marks_the_chain_of_one_pass(spark):
    draw = random.Random(4)
    rows, want = [], set()
    for s, n in (("A", 4000), ("B", 300), ("C", 1)):
        pos = sorted(draw.sample(range(10_000), n))
        free = [None if draw.random() < 0.001 else p + 1 + draw.choice([0, 0, 3, 40]) for p in pos]
        allowed = 0
        for p, f in zip(pos, free, strict=True):
            rows.append((s, 40, p, f))
            if allowed is not None and p >= allowed:
                want.add((s, p))
                allowed = f
    df = spark.createDataFrame(rows, "symbol string, window int, pos long, free long")
    for block in (64, 1000, 1 << 20):
        rounds = []
        got = ranges.chained(df, rounds, block)
        assert {(r.symbol, r.pos) for r in got.collect()} == want
        # the logarithm of the number of blocks; in one block no round at all
        assert rounds[0] <= (10_000 // block).bit_length()


@pytest.mark.parametrize("seed", [1])
def test_rounds_choose_what_one_by_one_chooses(spark, seed):
    draw = random.Random(seed)
    rows = []
    for k in range(150):
        since = draw.randrange(0, 400)
        until = since + draw.randrange(5, 80)
        known = None if draw.random() < 0.1 else at(until + draw.randrange(0, 4), 24)
        rows.append(("S", 40 + k % 3, "primary" if k % 4 else "secondary", at(since, 24), at(until, 24), round(draw.random(), 2), at(since + 4, 24), known))
    c = RangeConfig(max_overlap=0.1, min_quality={"primary": 0.2, "secondary": 0.3})
    df = spark.createDataFrame(rows, "symbol string, window int, kind string, start timestamp, end timestamp, quality double, declared_at timestamp, confirmed_at timestamp")

    def key(r):
        secs = lambda t: int((t - BASE).total_seconds())
        return (r[5] * (secs(r[4]) - secs(r[3])), secs(r[3]), secs(r[4]), r[1], secs(r[6]))

    def greedy(own):
        taken = []
        for r in sorted(own, key=key, reverse=True):
            share = lambda a, b: (min(a[4], b[4]) - max(a[3], b[3])) / (max(a[4], b[4]) - min(a[3], b[3]))
            if not any(share(r, t) > c.max_overlap for t in taken):
                taken.append(r)
        return taken

    good = [r for r in rows if r[5] >= c.min_quality[r[2]]]
    want = {r for kind in c.min_quality for r in greedy([x for x in good if x[2] == kind])}
    assert {tuple(r) for r in ranges.select(df, c).collect()} == want and len(want) > 10
    known = [r for r in good if r[7] is not None]
    causal = {r for r in known if r in greedy([x for x in known if x[2] == r[2] and x[7] <= r[7]])}
    assert {tuple(r) for r in ranges.select_causally(df, c).collect()} == causal and causal != want


def test_suppression_rounds_grow_slowly(spark):
    draw = random.Random(6)
    nodes = spark.createDataFrame([("g", draw.random()) for _ in range(2000)], "g string, key double")
    keys = [r.key for r in nodes.collect()]
    pairs = {(max(a, b), min(a, b)) for a, b in (draw.sample(keys, 2) for _ in range(4000))}
    edges = spark.createDataFrame([("g", h, lo) for h, lo in pairs], "g string, heavy double, light double")
    rounds, beside, taken = [], {}, set()
    for h, lo in pairs:
        beside.setdefault(lo, []).append(h)
    for k in sorted(keys, reverse=True):
        if not taken.intersection(beside.get(k, ())):
            taken.add(k)
    got = {r.key for r in ranges.independent(nodes, edges, ["g", "key"], rounds).collect()}
    assert got == taken and rounds[0] <= 12


def test_one_series_in_many_blocks_is_detected_the_same(spark):
    rng = np.random.default_rng(9)
    x, level_at = [], 100.0
    for _ in range(5):
        for _ in range(110):
            x.append(level_at + (x[-1] - level_at if x else 0) * 0.6 + rng.normal(0, 1.2))
        level_at += rng.choice([-15, 15])
    from test_ranges_sequential import C

    candles = bars(spark, [round(v, 2) for v in x], wick=0.4)
    a, b = (sorted(map(tuple, ranges.detect(candles, C, block).collect()), key=repr) for block in (64, 4096))
    assert a == b and a
    assert ranges.detect(candles.limit(0), C).count() == 0


def test_no_task_holds_a_series(spark):
    """The only Python groups are blocks."""
    import inspect

    source = inspect.getsource(ranges)
    assert source.count("applyInPandas(") == 3 == source.count('groupBy("symbol", "window", "block").applyInPandas') + source.count('groupBy(*key, "block").applyInPandas')
    assert "applyInPandas" not in inspect.getsource(passage)
