"""Streams with keyed state against the batch operators, across restarts."""

from __future__ import annotations

import datetime as dt
import random

from helpers import BASE, at
from pyspark.sql import functions as F

from tapeweave.operators import asof, gaps, structure
from tapeweave.sources.store import shared_path
from tapeweave.streaming import ordered

CANDLES = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def _walk(seed, n, symbols="XY"):
    draw = random.Random(seed)
    rows = []
    for s in symbols:
        price = 100.0
        for k in range(n):
            price += draw.gauss(0, 1)
            rows.append((s, at(k, 1), price, price + 0.3, price - 0.3, round(price, 1), 1.0))
    return rows


def _fed(spark, rows, parts, build, schema=CANDLES, seed=1):
    """What the stream ``build`` makes gives after each part of the rows came in,
    in any order within the part, always from its checkpoint."""
    feed, folder = shared_path(spark, "feed"), shared_path(spark, "stream")
    draw, times = random.Random(seed), sorted({r[1] for r in rows})
    size = -(-len(times) // parts)
    out = None
    for k in range(parts):
        own = [r for r in rows if times[k * size] <= r[1] <= times[min(len(times), (k + 1) * size) - 1]]
        draw.shuffle(own)
        spark.createDataFrame(own, schema).repartition(3).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(schema).parquet(feed)
        out = ordered.run(spark, build(stream), folder)
    return out


def test_gaps_of_a_stream_are_those_of_the_batch(spark):
    rows = _walk(2, 240)
    got = _fed(spark, rows, 3, lambda s: ordered.stream_gaps(s, 3600))
    closed = max(r[1] for r in rows) - dt.timedelta(hours=1)
    candles = spark.createDataFrame(rows, CANDLES)
    want = gaps.evolution(gaps.detect(candles, 3600), candles).where(F.col("ts") <= F.lit(closed))
    columns = ["symbol", "gap_id", "kind", "top", "bottom", "confirmed_at", "ts", "edge", "alive"]
    a, b = (sorted(map(tuple, df.select(*columns).collect())) for df in (got, want))
    assert a == b and len({r[1] for r in a}) > 20 and any(not r[8] for r in a)


def test_pivots_of_a_stream_come_so_many_bars_later(spark):
    rows = _walk(3, 200)
    got = _fed(spark, rows, 4, lambda s: ordered.stream_pivots(s, 3))
    candles = spark.createDataFrame(rows, CANDLES)
    last = max(r[1] for r in rows) - dt.timedelta(hours=1 + 3)
    want = structure.pivots(candles, 3).where(F.col("ts") <= F.lit(last)).select("symbol", "ts", "close", "pivot_high", "pivot_low")
    a, b = sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))
    assert a == b and any(r[3] for r in a) and any(r[4] for r in a)


def test_late_and_repeated_bars_count_once_or_not(spark):
    rows = _walk(4, 60, "X")
    feed, folder = shared_path(spark, "feed"), shared_path(spark, "stream")
    late = ("X", at(5, 1), 1.0, 1.0, 1.0, 1.0, 1.0)  # long passed
    for part in (rows[:40] + [rows[39][:2] + (9.0,) * 5], [late, *rows[40:]]):
        # one file, so that the first of the repeats is known
        spark.createDataFrame(part, CANDLES).coalesce(1).write.mode("append").parquet(feed)
        got = ordered.run(spark, ordered.stream_pivots(spark.readStream.schema(CANDLES).parquet(feed), 3), folder)
    closes = {r.ts: r.close for r in got.collect()}
    assert closes == {r[1]: r[5] for r in rows[: len(closes)]} and len(closes) == 60 - 1 - 3


def test_funding_as_a_stream_join(spark):
    draw = random.Random(5)
    bars = [("X", BASE + dt.timedelta(hours=k)) for k in range(120)]
    rates = [("X", BASE + dt.timedelta(hours=5 * k, minutes=draw.randrange(300)), float(k)) for k in range(24)]
    feeds, folder = [shared_path(spark, "feed") for _ in "ab"], shared_path(spark, "stream")
    schemas = ["symbol string, ts timestamp", "symbol string, ts timestamp, funding double"]
    late = ("X", rates[4][1] + dt.timedelta(seconds=1), 99.0)  # comes when its time has passed for good
    for first in (True, False):
        for feed, schema, rows in zip(feeds, schemas, (bars, rates), strict=True):
            own = [r for r in rows if (r[1] < BASE + dt.timedelta(hours=60)) == first] + ([late] if rows is rates and not first else [])
            spark.createDataFrame(own, schema).write.mode("append").parquet(feed)
        streams = [spark.readStream.schema(schema).parquet(feed) for feed, schema in zip(feeds, schemas, strict=True)]
        got = ordered.run(spark, ordered.stream_asof(*streams, ["funding"], "12 HOURS"), folder)
    have = {r.ts: r.funding for r in got.collect()}
    want = asof.asof(spark.createDataFrame(bars, schemas[0]), spark.createDataFrame(rates, schemas[1]), ["funding"]).collect()
    closed = min(bars[-1][1], rates[-1][1]) - dt.timedelta(hours=13)
    assert have == {r.ts: r.funding for r in want if r.ts + dt.timedelta(seconds=1) <= closed} and len(have) > 80 and 99.0 not in have.values()


def test_funding_of_bars_anywhere_in_a_slot(spark):
    draw = random.Random(6)
    when = lambda hours: BASE + dt.timedelta(microseconds=draw.randrange(int(hours * 3.6e9)))
    bars = [(s, when(90), float(k)) for s in "XY" for k in range(150)]
    bars += [(s, t + dt.timedelta(microseconds=-1 if t.microsecond else 1), -c) for s, t, c in bars[::10]]  # two in one second
    # few enough that some bars have none, many in some hours, and one at a bar's own time
    rates = [(s, t, float(k)) for s in "XY" for k, t in enumerate([when(90) for _ in range(20)] + [when(2) for _ in range(80)] + [bars[7][1]])]
    feeds, folder = [shared_path(spark, "feed") for _ in "ab"], shared_path(spark, "stream")
    schemas = ["symbol string, ts timestamp, close double", "symbol string, ts timestamp, funding double"]
    for first in (True, False):
        for feed, schema, rows in zip(feeds, schemas, (bars, rates), strict=True):
            spark.createDataFrame([r for r in rows if (r[1] < BASE + dt.timedelta(hours=40)) == first], schema).write.mode("append").parquet(feed)
        streams = [spark.readStream.schema(schema).parquet(feed) for feed, schema in zip(feeds, schemas, strict=True)]
        got = ordered.run(spark, ordered.stream_asof(*streams, ["funding"], "5 HOURS"), folder)
    have = sorted(map(tuple, got.select("symbol", "ts", "close", "funding").collect()), key=str)
    closed = min(max(r[1] for r in rows) for rows in (bars, rates)) - dt.timedelta(hours=1 + 5)
    last = lambda s, t: max(((u, f) for z, u, f in rates if z == s and t - dt.timedelta(hours=5) < u <= t), default=(None, None))[1]
    want = sorted(((s, t, c, last(s, t)) for s, t, c in bars if t.replace(microsecond=0) + dt.timedelta(seconds=1) <= closed), key=str)
    assert have == want and len(have) > 200 and any(r[3] is None for r in have) and len({r[3] for r in have}) > 20


def _met(node):
    """Rows that the joins of an executed plan gave out."""
    below = node.children()
    own = node.metrics().apply("numOutputRows").value() if "Join" in node.nodeName() else 0
    return own + sum(_met(below.apply(k)) for k in range(below.size()))


def test_bars_do_not_meet_every_rate_of_their_past(spark):
    bars = spark.range(240).selectExpr("'X' AS symbol", f"timestamp'{BASE}' + make_dt_interval(0, id) AS ts")
    rates = spark.range(240 * 200).selectExpr("'X' AS symbol", f"timestamp'{BASE}' + make_dt_interval(0, 0, 0, 18 * id + 1) AS ts", "double(id) AS funding")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan that ran is hidden
    try:
        got = ordered.stream_asof(bars, rates, ["funding"], "2 DAYS")
        have = {r.ts: r.funding for r in got.collect()}
        met = _met(got._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert have == {BASE + dt.timedelta(hours=k): 200.0 * k - 1 if k else None for k in range(240)}
    assert 240 < met < 240 * 60  # a bar meets the slots of two days, not 9,600 rates


def test_state_is_dealt_by_cores_and_stays_so(spark):
    rows, (feed, folder) = _walk(7, 60, "XYZ"), [shared_path(spark, name) for name in ("feed", "stream")]
    name, cores = "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism
    before = spark.conf.get(name)
    try:
        for most, part in (("64", rows[::2]), ("3", [])):
            spark.conf.set(name, most)
            spark.createDataFrame(part, CANDLES).write.mode("append").parquet(feed)
            got = ordered.run(spark, ordered.stream_pivots(spark.readStream.schema(CANDLES).parquet(feed)), folder)
            state = spark.read.format("state-metadata").load(f"{folder}/state").collect()
            assert {r.numPartitions for r in state} == {max(16, 2 * cores)} and spark.conf.get(name) == most
    finally:
        spark.conf.set(name, before)
    assert got.count() > 60
