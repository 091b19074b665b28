"""Learned filter and learned sizing over trades."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import BacktestConfig
from ..functions.signals import learned_multiplier, phase_favours
from ..sources.candles import cumulative
from ..sources.store import written
from .asof import asof
from .indicators import bollinger, rolling_rank
from .metrics import acceptance

FEATURES = (
    "impulse", "adx", "di_oriented", "squeeze", "squeeze_bars", "stochastic_oriented", "ttm_oriented", "phase_favours", "bb_width_rank", "atr_relative", "divergence_favours",
    "quality", "confluence", "r_potential", "risk_pct", "is_long", "is_poc", "is_vah", "is_val",
)


def sample(trades: DataFrame, feats: DataFrame, config: BacktestConfig | None = None) -> DataFrame:
    """One row per trade with ``FEATURES`` from the bar before the one it was
    opened in (the last that had closed), oriented to its direction, and ``ts,
    score, pnl_r, wins, passes_rules``."""
    c = config or BacktestConfig()
    df = rolling_rank(bollinger(feats), "bb_width", out="bb_width_rank").withColumn("atr_relative", F.try_divide("atr", "close"))
    known = df.select(
        "symbol", "ts", "impulse", "adx", (F.col("di_plus") - F.col("di_minus")).alias("di"), F.coalesce(F.col("squeeze"), F.lit(False)).cast("double").alias("squeeze"),
        F.col("squeeze_bars").cast("double").alias("squeeze_bars"), "stochastic", "ttm", "ttm_phase", "bb_width_rank", "atr_relative", "standing",
    )
    names = [n for n in known.columns if n not in ("symbol", "ts")]
    # the bar before each bar, keyed by the bar's own time
    w = Window.partitionBy("symbol").orderBy("ts")
    shifted = known.select("symbol", "ts", *[F.coalesce(F.lag(n).over(w), F.when(F.row_number().over(w) == 1, F.col(n))).alias(n) for n in names])
    rows = trades.withColumn("ts", F.col("entry_ts")).withColumnRenamed("quality", "quality_t")
    j = asof(rows.select("symbol", "scenario", "seq", "ts", "direction", "level", "quality_t", "confluence", "r_potential", "risk_pct", "score", "pnl_r"), shifted, names)
    sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    expected = F.when(sign > 0, "bullish").otherwise("bearish")
    return j.select(
        "symbol", "scenario", "seq", "ts", F.col("score").cast("int"), "pnl_r", (F.col("pnl_r") > 0).cast("int").alias("wins"), "impulse", "adx", (F.col("di") * sign).alias("di_oriented"), "squeeze", "squeeze_bars",
        F.when(sign > 0, F.col("stochastic")).otherwise(100 - F.col("stochastic")).alias("stochastic_oriented"), (F.col("ttm") * sign).alias("ttm_oriented"),
        F.coalesce(phase_favours("ttm_phase", sign), F.lit(False)).cast("double").alias("phase_favours"), "bb_width_rank", "atr_relative",
        F.coalesce(F.col("standing") == expected, F.lit(False)).cast("double").alias("divergence_favours"), F.col("quality_t").alias("quality"), F.col("confluence").cast("double"), "r_potential", "risk_pct",
        (sign > 0).cast("double").alias("is_long"), *[(F.col("level") == k).cast("double").alias(f"is_{k}") for k in ("poc", "vah", "val")],
        F.coalesce((F.col("squeeze") == 0) & (F.col("adx") < c.max_adx) & (F.col("impulse") >= c.min_impulse), F.lit(False)).alias("passes_rules"),
    )


def _prepared(stages: list) -> Pipeline:
    names = list(FEATURES)
    filled = [f"__{n}" for n in names]
    return Pipeline(stages=[Imputer(inputCols=names, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw", handleInvalid="keep"), *stages])


def logistic(rows: int, c: float = 0.1) -> Pipeline:
    """Standardised ridge logistic regression; ``c`` is inverse strength."""
    return _prepared([StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol="wins", regParam=1 / (c * max(1, rows)), maxIter=200, standardization=False)])


def boosted(depth: int = 3, rounds: int = 120, step: float = 0.05, leaf: int = 25) -> Pipeline:
    """Gradient-boosted trees."""
    return _prepared([GBTClassifier(featuresCol="raw", labelCol="wins", maxDepth=depth, maxIter=rounds, stepSize=step, minInstancesPerNode=leaf, seed=7)])


def probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``probability`` of a win."""
    return rows.drop("raw", "features").join(
        model.transform(rows).select("symbol", "scenario", "seq", vector_to_array("probability")[1].alias("probability")), ["symbol", "scenario", "seq"]
    )


def ordered_split(rows: DataFrame, share: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Earlier and later rows by entry time."""
    marked = _numbered(rows).join(F.broadcast(rows.agg(F.count("*").alias("__all"))))  # one row
    early = F.col("__n") < F.floor(F.col("__all") * share)
    return marked.where(early).drop("__n", "__all"), marked.where(~early).drop("__n", "__all")


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``__n``, the place of each row by entry time from 0, counted inside
    months and over months."""
    month = F.floor(F.unix_seconds("ts") / (30 * 86400))
    counted = cumulative(rows.withColumn("__one", F.lit(1).cast("long")), "__one", "__n", month, ["ts", "symbol", "scenario", "seq"])
    return counted.withColumn("__n", F.col("__n") - 1).drop("__one")


def evaluated(train: DataFrame, test: DataFrame, pipeline: Pipeline, label: str) -> DataFrame:
    """Acceptance of ``test`` by a model of ``train``, at the threshold that lets
    through as many training trades as the rules do; beside it all trades and
    those that pass the rules."""
    model = pipeline.fit(train)
    quota = train.agg(F.avg(F.col("passes_rules").cast("double"))).first()[0]
    judged = probabilities(model, test).withColumn("ok", F.col("probability") >= threshold(probabilities(model, train), quota))
    return (
        acceptance(test.withColumn("all", F.lit(True)), "all", "unfiltered").unionByName(acceptance(test, "passes_rules", "rules")).unionByName(acceptance(judged, "ok", label))
    )


def crossed(rows: DataFrame, pairs: list[tuple[str, str]], pipeline=None, label: str = "logistic") -> DataFrame:
    """``evaluated`` for models fitted on all trades of one symbol and judged on
    all of another: adds ``origin, target``."""
    parts = []
    for origin, target in pairs:
        train, test = rows.where(F.col("symbol") == origin), rows.where(F.col("symbol") == target)
        made = pipeline or logistic(train.count())
        parts.append(evaluated(train, test, made, label).withColumns({"origin": F.lit(origin), "target": F.lit(target)}))
    return reduce(DataFrame.unionByName, parts)


def threshold(train: DataFrame, quota: float) -> float:
    """The probability that a share ``quota`` of the training rows reaches."""
    return train.agg(F.percentile("probability", F.lit(1 - quota))).first()[0]


def coefficients(model: PipelineModel, spark) -> DataFrame:
    """Features of a logistic model by size of their weight."""
    weights = [float(x) for x in model.stages[-1].coefficients]
    return spark.createDataFrame(list(zip(FEATURES, weights)), "feature string, weight double").orderBy(F.abs("weight").desc())


#: Rows of one fold that meet in a task, and the most Newton steps.
CHUNK, STEPS = 20_000, 50


def walk_forward(rows: DataFrame, start: int = 40, step: int = 10, c: float = 0.1, steps: list[int] | None = None) -> DataFrame:
    """``rows`` with ``multiplier``: trade ``k`` is sized by a logistic model
    (``logistic``) of all trades before its block of ``step``, relative to that
    model's mean training probability; the first ``start`` trades, and blocks
    whose past has one class only, get 1.

    All blocks' models are fitted at once: each Newton step is one aggregate of
    gradients and curvatures, keyed by block and chunk of rows.  Steps go on
    until no model moves; ``steps`` is given their number.
    """
    given = [F.when(~F.isnan(n), F.col(n)).alias(n) if t == "double" else F.col(n).cast("double").alias(n) for n, t in rows.select(*FEATURES).dtypes]
    numbered = written(_numbered(rows))
    total = numbered.count()
    last = (total - start - 1) // step
    if last < 0:
        return numbered.withColumn("multiplier", F.lit(1.0)).drop("__n")
    own = F.greatest(F.lit(0), F.expr(f"(__n - {start}) div {step}"))  # the block of a row behind the start
    first = F.when(F.col("__n") < start, F.lit(0).cast("long")).otherwise(own + 1)
    past = numbered.select("__n", F.col("wins").cast("double").alias("wins"), *given, F.explode(F.sequence(first, F.greatest(first, F.lit(last)))).alias("fold")).where(f"fold <= {last}")
    marks = past.groupBy("fold").agg(F.count("*").alias("n"), F.avg("wins").alias("share"), *[F.percentile_approx(n, 0.5, 10_000).alias(f"m_{n}") for n in FEATURES]).where("share > 0 AND share < 1")
    filled = past.join(marks, "fold").select("fold", "__n", "wins", *[F.coalesce(n, f"m_{n}").alias(n) for n in FEATURES])
    scale = written(marks.join(filled.groupBy("fold").agg(*[F.avg(n).alias(f"a_{n}") for n in FEATURES], *[F.stddev_samp(n).alias(f"s_{n}") for n in FEATURES]), "fold"))

    def shaped(df: DataFrame, *keep: str) -> DataFrame:
        """Features as ``x``: filled, standardised by their fold, then a one."""
        one = lambda n: F.coalesce(F.try_divide(F.coalesce(n, f"m_{n}") - F.col(f"a_{n}"), F.nullif(f"s_{n}", F.lit(0.0))), F.lit(0.0))
        return df.join(scale, "fold").select("fold", *keep, F.array(*[one(n) for n in FEATURES], F.lit(1.0)).alias("x"))

    known = shaped(past, "__n", "wins").withColumn("chunk", F.expr(f"__n div {CHUNK}"))
    size = len(FEATURES) + 1
    weights = scale.select("fold", "n", F.array_repeat(F.lit(0.0), size).alias("w"))

    def curve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, w = np.stack(pdf["x"].to_numpy()), pdf["wins"].to_numpy(), np.asarray(pdf["w"].iloc[0])
        p = 1 / (1 + np.exp(-(x @ w)))
        return pd.DataFrame({"fold": [key[0]], "n": [pdf["n"].iloc[0]], "w": [w.tolist()], "g": [(x.T @ (p - y)).tolist()], "h": [((x.T * (p * (1 - p))) @ x).ravel().tolist()]})

    def move(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, w = float(pdf["n"].iloc[0]), np.asarray(pdf["w"].iloc[0])
        ridge = np.full(size, 1 / (c * n))
        ridge[-1] = 0.0  # the level is free
        g = np.sum(np.stack(pdf["g"].to_numpy()), axis=0) / n + ridge * w
        h = np.sum(np.stack(pdf["h"].to_numpy()), axis=0).reshape(size, size) / n + np.diag(ridge)
        by = np.linalg.lstsq(h, g, rcond=None)[0]
        return pd.DataFrame({"fold": [key[0]], "n": [int(n)], "w": [(w - by).tolist()], "moved": [float(np.abs(by).max())]})

    kind = "fold long, n long, w array<double>"
    for k in range(STEPS):
        parts = known.join(weights, "fold").groupBy("fold", "chunk").applyInPandas(curve, f"{kind}, g array<double>, h array<double>")
        moved = written(parts.groupBy("fold").applyInPandas(move, f"{kind}, moved double"))
        weights = moved.drop("moved")
        if steps is not None:
            steps.append(k + 1)
        if moved.where("moved > 1e-9").isEmpty():
            break
    chance = 1 / (1 + F.exp(-F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)))
    reference = known.join(weights, "fold").groupBy("fold").agg(F.avg(chance).alias("reference"))
    blocks = numbered.where(F.col("__n") >= start).select("__n", *given, own.alias("fold"))
    sized = shaped(blocks, "__n").join(weights, "fold").join(reference, "fold").select("__n", learned_multiplier(chance, F.col("reference")).alias("multiplier"))
    return numbered.join(sized, "__n", "left").withColumn("multiplier", F.coalesce("multiplier", F.lit(1.0))).drop("__n")
