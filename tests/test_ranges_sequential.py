"""The range detector against a plain bar-by-bar version of its rules."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import at, bars

from tapeweave.config import RangeConfig, RangeWindow
from tapeweave.operators import ranges

C = RangeConfig(windows=(RangeWindow(40, "secondary"), RangeWindow(60, "primary")), max_height_atr=30.0, min_crossings=3, min_containment=0.8, band_atr=3.0, closes_outside=3, min_edge_bars=8, free_height_pct=9.0)


def run_of(flags, n):
    """First index at which ``n`` true flags in a row begin."""
    streak = 0
    for i, f in enumerate(flags):
        streak = streak + 1 if f else 0
        if streak == n:
            return i - n + 1
    return None


def level(pivots, band, gap, up):
    for _, price in sorted(((-p if up else p), p) for _, p in pivots):
        count, last = 0, -(10**9)
        for i, p in pivots:
            inside = price - band <= p <= price if up else price <= p <= price + band
            if inside and i - last >= gap:
                count, last = count + 1, i
        if count >= C.min_touches:
            return price, count
    return None


def changes(signs):
    signs = [s for s in signs if s]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def r2(x):
    if np.ptp(x) == 0:
        return None
    return np.corrcoef(x, np.arange(len(x)))[0, 1] ** 2


def sequential(high, low, close, n):
    """(declared, start, end, confirmed, ceiling, floor) of each range."""
    tr = [max(high[i] - low[i], *([abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])] if i else [0])) for i in range(len(close))]
    k = C.pivot_bars
    piv = {up: [(i, close[i]) for i in range(k, len(close) - k) if all((close[i] > close[j]) if up else (close[i] < close[j]) for j in range(i - k, i + k + 1) if j != i)] for up in (True, False)}
    found, t = [], n - 1
    while t < len(close):
        here, t = t, t + 1
        x = close[here - n + 1 : here + 1]
        fit = r2(np.array(x))
        if fit is None or fit >= C.max_r2 or here < C.atr_period - 1:
            continue
        atr = np.mean(tr[here - C.atr_period + 1 : here + 1])
        sides = [level([(i, p) for i, p in piv[up] if here - n + 1 <= i <= here - k], atr * C.band_atr, C.touch_gap(n), up) for up in (True, False)]
        if None in sides or sides[0][0] <= sides[1][0]:
            continue
        top, bottom = sides[0][0], sides[1][0]
        height = top - bottom
        out = [not bottom <= c <= top for c in close]
        slope = np.polyfit(np.arange(n), x, 1)[0]
        window_out = out[here - n + 1 : here + 1]
        zone = [-1 if c <= bottom + C.edge_band * height else 1 if c >= top - C.edge_band * height else 0 for c in x]
        if (
            height / atr > C.height_cap(n) or height / bottom > C.max_height_pct or abs(slope) * n >= C.max_drift * height or 1 - np.mean(window_out) < C.min_containment
            or run_of(window_out, C.closes_outside) is not None or changes(np.sign(np.array(x) - (top + bottom) / 2).tolist()) < C.min_crossings or changes(zone) < C.min_trips
        ):
            continue
        a = here - n + 1
        back = run_of(out[:a][::-1], C.closes_outside)
        a = 0 if back is None else a - back
        run = run_of(out[a:], C.closes_outside)
        b, confirmed = (len(close) - 1, None) if run is None else (a + run - 1, a + run + C.closes_outside - 1)
        while a <= b and out[a]:
            a += 1
        while b >= a and out[b]:
            b -= 1
        starts = [i for i in range(a, b + 1) if not out[i] and np.mean([not o for o in out[i : b + 1]]) >= C.min_containment]
        if a > b or not starts:
            continue
        a, edge = starts[0], C.edge_bars(n)
        heads = []
        for i in range(a, b + 1):
            part, fit = out[i : min(b + 1, i + edge)], None
            if i + edge <= b + 1:
                fit = r2(np.array(close[i : i + edge]))
            if not out[i] and 1 - np.mean(part) >= C.min_containment and (fit is None or fit < C.max_r2):
                heads.append(i)
        a = heads[0] if heads else b
        tails = [i for i in range(a, b + 1) if not out[i] and 1 - np.mean(out[max(a, i - edge + 1) : i + 1]) >= C.min_containment]
        b = tails[-1] if tails else a
        if b - a + 1 < int(n * C.min_duration_fraction):
            continue
        found.append((here, a, b, confirmed, top, bottom))
        t = len(close) if confirmed is None else max(here, confirmed) + 1
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_detector_equals_the_sequential_version(spark, seed):
    rng = np.random.default_rng(seed)
    x, level_at = [], 100.0
    for _ in range(4):  # stretches of reverting prices, and moves between them
        for _ in range(110):
            x.append(level_at + (x[-1] - level_at if x else 0) * 0.6 + rng.normal(0, 1.2))
        level_at += rng.choice([-15, 15])
    x = [round(v, 2) for v in x]
    wick = 0.4
    got = ranges.detect(bars(spark, x, wick=wick), C).collect()
    want = {(n, *(at(i) for i in r[:3]), None if r[3] is None else at(r[3]), round(r[4], 6), round(r[5], 6)) for n in (40, 60) for r in sequential([v + wick for v in x], [v - wick for v in x], x, n)}
    assert {(r.window, r.declared_at, r.start, r.end, r.confirmed_at, round(r.ceiling, 6), round(r.floor, 6)) for r in got} == want
    assert want
