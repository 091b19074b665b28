"""All blocks' models fitted at once against one fit after the other."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import at

from tapeweave.operators import learning


def _rows(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, len(learning.FEATURES)))
    x[:, -1] = 1.0  # a feature that never varies
    chance = 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1])))
    wins = (rng.random(n) < chance).astype(int)
    wins[:45] = 0  # the first block's past has one class
    x[rng.random(x.shape) < 0.03] = np.nan
    return x, wins


def _one_by_one(x, wins, start, step, c=0.1):
    out = np.ones(len(wins))
    for at_ in range(start, len(wins), step):
        past, y = x[:at_], wins[:at_]
        if len(set(y)) < 2:
            continue
        middle = np.array([np.sort(v[~np.isnan(v)])[(np.sum(~np.isnan(v)) + 1) // 2 - 1] for v in past.T])
        fill = lambda v: np.where(np.isnan(v), middle, v)  # noqa: B023, E731
        mean, sd = fill(past).mean(axis=0), fill(past).std(axis=0, ddof=1)
        sd = np.where(sd < 1e-12, np.inf, sd)
        shape = lambda v: np.column_stack([(fill(v) - mean) / sd, np.ones(len(v))])  # noqa: B023, E731
        z, w = shape(past), np.zeros(x.shape[1] + 1)
        ridge = np.full(len(w), 1 / (c * at_))
        ridge[-1] = 0
        for _ in range(100):
            p = 1 / (1 + np.exp(-(z @ w)))
            w = w - np.linalg.lstsq((z.T * (p * (1 - p))) @ z / at_ + np.diag(ridge), z.T @ (p - y) / at_ + ridge * w, rcond=None)[0]
        reference = (1 / (1 + np.exp(-(z @ w)))).mean()
        chance = 1 / (1 + np.exp(-(shape(x[at_ : at_ + step]) @ w)))
        out[at_ : at_ + step] = np.clip(1 + 12 * (chance - reference), 0.5, 2.0)
    return out


@pytest.mark.parametrize(("n", "start", "step"), [(230, 40, 30), (30, 40, 10)])
def test_walk_forward_equals_one_fit_after_the_other(spark, monkeypatch, n, start, step):
    monkeypatch.setattr(learning, "CHUNK", 50)
    x, wins = _rows(n, 3)
    rows = [("X", "s", k, at(k), int(w), *map(float, v)) for k, (v, w) in enumerate(zip(x, wins, strict=True))]
    df = spark.createDataFrame(rows, "symbol string, scenario string, seq long, ts timestamp, wins int, " + ", ".join(f"{f} double" for f in learning.FEATURES))
    steps = []
    got = learning.walk_forward(df, start, step, steps=steps).orderBy("seq").toPandas()["multiplier"].to_numpy()
    np.testing.assert_allclose(got, _one_by_one(x, wins, start, step), atol=1e-7)
    assert not steps or len(steps) < 20
