"""Fixed-range volume profiles, their levels, and grids of levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ProfileConfig
from ..schema import OHLCV, require_columns
from ..sources.store import written
from . import passage
from .asof import in_intervals, next_bar, positions


def granularity(bars: Column) -> Column:
    """The candles a profile is built from, by the range's decision bars."""
    return F.when(bars < 60, "fine").when(bars <= 200, "middle").otherwise("coarse")


def volume_by_bin(candles: DataFrame, ranges: DataFrame, config: ProfileConfig | None = None) -> DataFrame:
    """``range_id, bin, volume, low, high``: each candle's volume spread evenly
    over the bins it overlaps, out of equal bins between the range's extremes.

    ``ranges`` has ``range_id, symbol, start, end``.  Only overlapped bins are
    made.  A candle without height goes to its single bin.  Ranges without
    volume or height give no rows.
    """
    n = (config or ProfileConfig()).bins
    require_columns(candles, "symbol", "ts", *OHLCV)
    inside = in_intervals(candles.select("symbol", "ts", "high", "low", "volume"), ranges.select("range_id", "symbol", "start", "end"))
    ends = inside.groupBy("range_id").agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.sum("volume").alias("total")).where("total > 0 AND hi > lo")
    df = inside.join(ends, "range_id").withColumn("width", (F.col("hi") - F.col("lo")) / n)
    place = lambda c: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - F.col("lo")) / F.col("width")).cast("int")))
    df = df.withColumns({"k0": place("low"), "k1": F.when(F.col("high") > F.col("low"), place("high")).otherwise(place("low"))})
    return _swept(df)


def _swept(df: DataFrame) -> DataFrame:
    """Volume of each bin from the candles' first and last bins ``k0`` and
    ``k1``, as a sweep along the bins.

    A candle gives four events at most: its parts of its first and last bin,
    where its even run through the bins between begins and where it ends.  What
    lies between events follows from their running sums.
    """
    edge = lambda k: F.col("lo") + k * F.col("width")
    flat, height = F.col("high") <= F.col("low"), F.col("high") - F.col("low")
    part = lambda k: F.when(flat, F.col("volume")).otherwise(F.col("volume") * F.greatest(F.lit(0.0), F.least("high", edge(k + 1)) - F.greatest("low", edge(k))) / height)

    def event(k: Column, point: Column, run: Column, full: int, cover: int) -> Column:
        return F.struct(k.alias("bin"), point.cast("double").alias("point"), run.cast("double").alias("run"), F.lit(full).alias("full"), F.lit(cover).alias("cover"))

    k0, k1, none = F.col("k0"), F.col("k1"), F.lit(0.0)
    even = F.col("volume") * F.col("width") / height
    short = F.array(event(k0, part(k0), none, 0, 1), event(k0 + 1, none, none, 0, -1))
    long = F.array(event(k0, part(k0), none, 0, 1), event(k0 + 1, none, even, 1, 0), event(k1, part(k1), -even, -1, 0), event(k1 + 1, none, none, 0, -1))
    events = df.select("range_id", "lo", "hi", F.explode(F.when(k0 == k1, short).otherwise(long)).alias("e")).select("range_id", "lo", "hi", "e.*")
    at = events.groupBy("range_id", "lo", "hi", "bin").agg(*[F.sum(x).alias(x) for x in ("point", "run", "full", "cover")])
    along = Window.partitionBy("range_id", "lo", "hi").orderBy("bin")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    # where no run is under way nothing is left of the sums' rounding
    through = F.when(F.sum("full").over(upto) > 0, F.sum("run").over(upto)).otherwise(0.0)
    at = at.withColumns({"through": through, "covers": F.sum("cover").over(upto), "until": F.lead("bin").over(along) - 1}).where("covers > 0")
    bins = at.select("range_id", "lo", "hi", F.col("bin").alias("first"), "point", "through", F.explode(F.sequence("bin", "until")).alias("bin"))
    volume = F.col("through") + F.when(F.col("bin") == F.col("first"), F.col("point")).otherwise(0.0)
    return bins.select("range_id", "bin", volume.alias("volume"), F.col("lo").alias("low"), F.col("hi").alias("high"))


def profiles(candles: DataFrame, ranges: DataFrame, config: ProfileConfig | None = None) -> DataFrame:
    """``range_id, poc, vah, val, volume_total, volumes`` of each range.

    The peak is the heaviest bin, of equals the one nearest the middle, of
    those the lower.  From it the value area takes the heavier of the two bins
    above and the two below until it holds its share; ties go up.
    """
    c = config or ProfileConfig()
    n = c.bins
    bins = volume_by_bin(candles, ranges, c)
    zero = bins.select("range_id", "low", "high").distinct().select("range_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"), F.lit(0.0).alias("volume"), "low", "high")
    dense = bins.unionByName(zero).groupBy("range_id", "low", "high", "bin").agg(F.sum("volume").alias("volume"))
    # equal bins stay equal through the rounding of their sums
    dense = dense.withColumn("rank", F.round(F.col("volume") / F.sum("volume").over(Window.partitionBy("range_id", "low", "high")), 12))
    rows = dense.groupBy("range_id", "low", "high").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("bin", "volume"))), lambda x: x["volume"]).alias("volumes"),
        F.min_by("bin", F.struct(-F.col("rank"), F.abs(F.col("bin") - F.lit((n - 1) / 2)), F.col("bin"))).alias("peak"), F.sum("volume").alias("volume_total"),
    )
    at = lambda k: F.coalesce(F.try_element_at("volumes", k + 1), F.lit(0.0))

    def grow(state: Column, _: Column) -> Column:
        low, high, held = state["low"], state["high"], state["held"]
        above = F.when(high >= n - 1, F.lit(-1.0)).otherwise(at(high + 1) + at(high + 2))
        below = F.when(low <= 0, F.lit(-1.0)).otherwise(F.when(low >= 2, at(low - 2)).otherwise(F.lit(0.0)) + at(low - 1))
        done = (held >= F.col("volume_total") * c.value_area) | ((low <= 0) & (high >= n - 1))
        up = above >= below
        return F.struct(
            F.when(done | up, low).otherwise(F.greatest(F.lit(0), low - 2)).alias("low"), F.when(done | ~up, high).otherwise(F.least(F.lit(n - 1), high + 2)).alias("high"),
            F.when(done, held).otherwise(held + F.greatest(above, below)).alias("held"),
        )

    start = F.struct(F.col("peak").alias("low"), F.col("peak").alias("high"), at(F.col("peak")).alias("held"))
    area = F.aggregate(F.sequence(F.lit(1), F.lit(n // 2 + 1)), start, grow)
    width = (F.col("high") - F.col("low")) / n
    return rows.withColumn("area", area).select(
        "range_id", (F.col("low") + (F.col("peak") + 0.5) * width).alias("poc"), (F.col("low") + (F.col("area.high") + 1) * width).alias("vah"),
        (F.col("low") + F.col("area.low") * width).alias("val"), "volume_total", "volumes",
    )


def graded_profiles(ranges: DataFrame, decision: DataFrame, by_grade: dict[str, DataFrame], config: ProfileConfig | None = None) -> DataFrame:
    """Profiles built from finer candles the shorter a range is.  ``by_grade``
    has the candles for ``fine``, ``middle`` and ``coarse``; a grade that is
    missing raises ``KeyError``."""
    if missing := {"fine", "middle", "coarse"} - set(by_grade):
        raise KeyError(f"no candles for {sorted(missing)}")
    inside = in_intervals(decision.select("symbol", "ts"), ranges.select("range_id", "symbol", "start", "end"))
    grades = inside.groupBy("range_id").agg(granularity(F.count("*")).alias("grade"))
    graded = ranges.join(grades, "range_id")
    parts = [profiles(candles, graded.where(F.col("grade") == grade), config) for grade, candles in sorted(by_grade.items())]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def in_view(rows: DataFrame, start, end) -> DataFrame:
    """Rows with ``start, end`` that reach into a span of time."""
    return rows.where((F.col("end") >= start) & (F.col("start") <= end))


def rebinned(profile: DataFrame, bins: int, groups: int = 90) -> DataFrame:
    """A profile in long form (``range_id, bin, volume, low, high``) in fewer
    bins for display: mean price and summed volume of each group."""
    price = F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / bins
    return profile.groupBy("range_id", F.floor(F.col("bin") * groups / bins).alias("group")).agg(F.avg(price).alias("price"), F.sum("volume").alias("volume"))


def level_grid(ranges: DataFrame, profile: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Three rows per range with a profile: ``symbol, range_id, window, kind,
    level, price, quality, valid_from, start, end``.  Ranges that are still
    open are left out."""
    rows = ranges.where(F.col("confirmed_at").isNotNull())
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(list(kinds)))
    three = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(k).alias("price")) for k in ("val", "poc", "vah")]))
    return rows.join(profile.select("range_id", "val", "poc", "vah"), "range_id").select(
        "symbol", "range_id", "window", "kind", three.alias("x"), "quality", F.col("confirmed_at").alias("valid_from"), "start", "end"
    ).select("symbol", "range_id", "window", "kind", "x.level", "x.price", "quality", "valid_from", "start", "end")


def displaced(levels: DataFrame, runs: int = 20, low: float = 0.03, high: float = 0.15, seed: int = 20260902) -> DataFrame:
    """Control grids: ``runs`` copies with every price moved up or down by a
    hashed-uniform share; adds ``run``.  Same draw on every machine."""
    key = F.concat_ws("/", F.lit(str(seed)), F.col("run").cast("string"), "symbol", "range_id", "level")
    draw = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), key)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    copies = levels.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    move = (F.lit(low) + F.lit(high - low) * draw("size")) * F.when(draw("sign") < 0.5, -1.0).otherwise(1.0)
    return copies.withColumn("price", F.col("price") * (1 + move))


def pick_targets(entry: Column, direction: Column, grid: Column, apart: float, most: int, first_apart: Column | None = None) -> Column:
    """Up to ``most`` prices of the array ``grid`` on the profit side of
    ``entry``, nearest first, each at least ``apart`` (a share) from the last
    one taken; the first may need ``first_apart``."""
    first_apart = F.lit(apart) if first_apart is None else first_apart
    side = F.filter(grid, lambda p: p.isNotNull() & ~F.isnan(p) & ((p - entry) * direction > 0))
    nearest = F.transform(F.array_sort(F.transform(side, lambda p: p * direction)), lambda p: p * direction)
    start = F.struct(entry.cast("double").alias("ref"), F.array().cast("array<double>").alias("taken"))

    def take(state: Column, price: Column) -> Column:
        n = F.size(state["taken"])
        need = F.abs(state["ref"]) * F.when(n == 0, first_apart).otherwise(F.lit(apart))
        ok = (n < most) & (F.abs(price - state["ref"]) >= need)
        return F.struct(F.when(ok, price).otherwise(state["ref"]).alias("ref"), F.when(ok, F.array_append(state["taken"], price)).otherwise(state["taken"]).alias("taken"))

    return F.aggregate(nearest, start, take, lambda s: s["taken"])


def picked_targets(entries: DataFrame, levels: DataFrame, apart: float, most: int, first_apart: float | None = None) -> DataFrame:
    """``entries`` (``symbol, price, direction``) with ``targets``: what
    ``pick_targets`` takes from all prices of ``levels``.

    The different prices of each symbol and side stand in order in a tree of
    extremes, and each target is a search for the first that is far enough: no
    entry meets a list of prices.
    """
    side = F.explode(F.array(F.lit(1), F.lit(-1))).alias("direction")
    prices = levels.where("price IS NOT NULL AND NOT isnan(price)").select("symbol", F.col("price").cast("double").alias("target")).distinct().select("*", side)
    key = lambda: F.concat_ws("/", F.col("direction").cast("string"), "symbol").alias("__side")
    order = Window.partitionBy("__side").orderBy(F.col("target") * F.col("direction"))
    placed = prices.select(key(), "target", "direction").withColumn("pos", (F.row_number().over(order) - 1).cast("long")).withColumn("ahead", F.col("target") * F.col("direction"))
    tree = passage.build(placed.select("__side", "pos", "ahead", "target"), {"ahead": "max"}, ["target"], key="__side")
    state = entries.withColumns({"__side": key(), "__ref": F.col("price").cast("double"), "targets": F.array().cast("array<double>"), "__pos": F.lit(0).cast("long")})
    for _ in range(most):
        share = F.when(F.size("targets") == 0, F.lit(apart if first_apart is None else first_apart)).otherwise(F.lit(apart))
        state = state.withColumn("__need", F.abs("__ref") * share)
        far = lambda x, leaf: (x["ahead"] - F.col("__ref") * F.col("direction") >= F.col("__need")) & (x["ahead"] > F.col("price") * F.col("direction"))
        found = passage.first_passage(state, tree, F.col("__pos"), far, "__at")
        # one row of the tree more says which price that is
        met = tree.levels[0].select(F.col("__side").alias("__own"), F.col("node").alias("__node"), F.col("kids"))
        found = found.join(met, (F.col("__side") == F.col("__own")) & (F.expr(f"__at div {tree.fan}") == F.col("__node")), "left")
        got = F.get("kids", F.pmod(F.col("__at"), F.lit(tree.fan)).cast("int"))["target"]
        found = found.withColumn("__got", got)
        state = found.select(*entries.columns, "__side", F.coalesce("__got", "__ref").alias("__ref"), F.coalesce("__at", "__pos").alias("__pos"), F.when(F.col("__got").isNull(), F.col("targets")).otherwise(F.array_append("targets", F.col("__got"))).alias("targets"))
    return state.select(*entries.columns, "targets")


def touches(candles: DataFrame, levels: DataFrame) -> DataFrame:
    """Every touch of a level: a decision bar after ``valid_from`` whose next
    bar spans the price, unless the close lies on it.

    A level goes down a tree of extremes over the bars, into the nodes that lie
    behind ``valid_from`` and span its price; it meets no bar that it does not
    touch but those beside one that it does.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    next_to = candles.select("symbol", "ts", "close", F.lead("ts").over(w).alias("next_ts"), F.lead("low").over(w).alias("low"), F.lead("high").over(w).alias("high"))
    bars = written(positions(next_to.where("next_ts IS NOT NULL")))
    tree = passage.build(bars, {"low": "min", "high": "max"}, ["ts", "next_ts", "close"])
    begun = next_bar(levels.select("symbol", "range_id", "level", "price", F.col("valid_from").alias("ts")), bars).withColumnRenamed("pos", "since").drop("ts")
    spans = lambda k, leaf: (k["low"] <= F.col("price")) & (k["high"] >= F.col("price"))
    found = passage.every_passage(begun, tree, F.col("since"), spans).where("bar.close <> price")
    return found.select("symbol", "bar.ts", "bar.next_ts", "range_id", "level", "price", F.when(F.col("bar.close") > F.col("price"), 1).otherwise(-1).alias("direction"))
