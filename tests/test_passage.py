"""Searches in the tree of extremes against a walk along the bars."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tapeweave.operators import passage


def _series(spark, n=700, symbols="AB"):
    draw = random.Random(4)
    rows = []
    for s in symbols:
        price = 100.0
        for k in range(n if s == "A" else n // 3):
            price += draw.gauss(0, 1)
            rows.append((s, k, round(price - 0.5, 2), round(price + 0.5, 2)))
    return rows, spark.createDataFrame(rows, "symbol string, pos long, low double, high double")


@pytest.mark.parametrize(("fan", "back"), [(2, False), (8, False), (8, True), (64, True)])
def test_first_passage_is_the_walk_s(spark, fan, back):
    rows, bars = _series(spark)
    tree = passage.build(bars, {"low": "min", "high": "max"}, fan=fan)
    draw = random.Random(5)
    queries = [(k, draw.choice("ABC"), draw.randrange(-3, 750), round(draw.uniform(80, 120), 2)) for k in range(150)]
    asked = spark.createDataFrame(queries, "id long, symbol string, since long, price double")
    got = {r.id: r.found for r in passage.first_passage(asked, tree, F.col("since"), lambda k, leaf: (k["low"] <= F.col("price")) & (k["high"] >= F.col("price")), back=back, exact=False).collect()}
    by = {}
    for s, p, lo, hi in rows:
        by.setdefault(s, []).append((p, lo, hi))
    for i, s, since, price in queries:
        hits = [p for p, lo, hi in by.get(s, []) if lo <= price <= hi and (p <= since if back else p >= since)]
        # a start before the series has nothing before it, and finds nothing after it either
        want = None if since < 0 or not hits else (max(hits) if back else min(hits))
        if back and since >= len(by.get(s, [])) > 0:
            continue  # searches start within the series
        assert got[i] == want, (i, s, since, price)


def test_every_passage_is_the_walk_s(spark):
    rows, bars = _series(spark)
    tree = passage.build(bars, {"low": "min", "high": "max"}, fan=8)
    asked = spark.createDataFrame([(k, "AB"[k % 2], k * 13, 95.0 + k) for k in range(12)], "id long, symbol string, since long, price double")
    got = passage.every_passage(asked, tree, F.col("since"), lambda k, leaf: (k["low"] <= F.col("price")) & (k["high"] >= F.col("price")))
    want = {(k, p) for k in range(12) for s, p, lo, hi in rows if s == "AB"[k % 2] and p >= k * 13 and lo <= 95.0 + k <= hi}
    found = [(r.id, r.pos) for r in got.collect()]
    assert set(found) == want and len(found) == len(want) and want


def test_a_search_reads_two_nodes_a_level(spark):
    _, bars = _series(spark, 4000, "A")
    tree = passage.build(bars, {"high": "max"}, fan=8)
    assert len(tree.levels) == 4
    asked = spark.createDataFrame([(k, "A", k * 7, 1e9) for k in range(300)], "id long, symbol string, since long, price double")
    plan = passage.first_passage(asked, tree, F.col("since"), lambda k, leaf: k["high"] >= F.col("price"))
    # one row of the tree a join, and one join for each level up and down
    joins = plan._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")
    assert joins == 2 * len(tree.levels) - 1 and plan.count() == 300
