"""Trade metrics and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Trades per block of a running peak; ranges of values of a quantile.
BLOCK, MARKS = 4096, 64


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact interpolated quantiles, ``wanted`` as ``{name: (column, share)}``,
    per group of ``by`` (without it, one row).  Nulls don't count; a quantile of
    nothing is null; null is a group of its own.

    Values are counted, then dealt in ``MARKS`` ranges of about as many distinct
    ones; only the ranges that hold the wanted ranks are sorted.  Marks and ranges
    are one or two rows a quantile: without ``by`` they are broadcast, with it
    adaptive execution does so or splits a hot group's join.
    """
    few = (lambda df: df) if by else F.broadcast
    group, share = ["__group", "__name"], F.element_at(F.create_map(*[F.lit(x) for name, (_, q) in wanted.items() for x in (name, float(q))]), F.col("__name"))
    one_of = F.explode(F.array(*[F.struct(F.lit(name).alias("__name"), F.col(c).cast("double").alias("__value")) for name, (c, _) in wanted.items()]))
    # as a struct, a null group meets itself in joins
    rows = df.select(F.struct(F.lit(0).alias("__0"), *by).alias("__group"), one_of.alias("__x")).select("__group", "__x.*")
    given = rows.where("__value IS NOT NULL")
    counted = given.groupBy(*group, "__value").agg(F.count("*").alias("__n"))
    marks = counted.groupBy(*group).agg(F.percentile_approx("__value", F.array(*[F.lit(k / MARKS) for k in range(1, MARKS)]), F.lit(10 * MARKS)).alias("__marks"))
    dealt = counted.join(few(marks), group).select(*group, "__value", "__n", F.size(F.filter("__marks", lambda m: m < F.col("__value"))).alias("__range"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(*group, "__range").agg(F.sum("__n").alias("__size")).withColumns({
        "__before": F.coalesce(F.sum("__size").over(before), F.lit(0)), "__at": share * (F.sum("__size").over(Window.partitionBy(*group)) - 1),
    })
    holds = lambda rank: (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__size"))
    low, high = F.floor("__at"), F.ceil("__at")
    inner = Window.partitionBy(*group, "__range").orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.join(few(ranges.where(holds(low) | holds(high))), [*group, "__range"]).withColumn("__upto", F.col("__before") + F.sum("__n").over(inner))
    least = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("__value")))
    ends = ranked.groupBy(*group, "__at").agg(least(low).alias("__a"), least(high).alias("__b"))
    value = F.col("__a") + F.when(F.col("__b") > F.col("__a"), (F.col("__b") - F.col("__a")) * (F.col("__at") - low)).otherwise(0.0)
    found = ends.select(*group, value.alias("__q"))
    if by:
        found = found.unionByName(rows.select("__group").distinct(), allowMissingColumns=True)
    return found.groupBy(*(["__group"] if by else [])).agg(*[F.max(F.when(F.col("__name") == name, F.col("__q"))).alias(name) for name in wanted]).select(*[F.col("__group").getField(b).alias(b) for b in by], *wanted)


def summary(trades: DataFrame, capital: float, by: tuple[str, ...] = (), hours_per_bar: float = 0.25) -> DataFrame:
    """One row (per group of ``by``): count, win rate, total return, mean, median
    and total R, profit factor (infinite without losses), deepest drawdown of
    the capital in closing order (``seq``), mean adverse and favourable move,
    median duration.  Without ``by``, no trades give the defaults.  Both medians
    come from one pass over value counts (see ``quantiles``)."""
    # the running peak in two levels: inside blocks of trades, and over blocks
    rows = trades.withColumn("__b", F.floor(F.col("seq") / BLOCK))
    inner = Window.partitionBy(*by, "__b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*(by or (F.lit(1),))).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    block = F.struct(F.lit(0).alias("__0"), *by, "__b")  # as a struct, null groups meet
    heads = rows.groupBy(*by, "__b").agg(F.max("capital_after").alias("__top")).select(block.alias("__block"), F.max("__top").over(before).alias("__before"))
    rows = rows.withColumn("__inner", F.max("capital_after").over(inner)).withColumn("__block", block).join(heads, "__block")
    peak = F.greatest(F.lit(capital), "__inner", "__before")
    rows = rows.withColumn("__dd", F.least(F.lit(0.0), (F.col("capital_after") - peak) / peak))
    gain, loss = F.sum(F.when(F.col("pnl_pct") > 0, F.col("pnl_pct"))), F.sum(F.when(F.col("pnl_pct") < 0, -F.col("pnl_pct")))
    n = F.count("*")
    out = rows.groupBy(*by).agg(
        n.alias("n_trades"), F.avg((F.col("pnl_pct") > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.max_by("capital_after", "seq") / capital - 1, F.lit(0.0)).alias("total_return"), F.avg("pnl_r").alias("mean_r"),
        F.coalesce(F.sum("pnl_r"), F.lit(0.0)).alias("total_r"),
        F.when(n > 0, F.when(loss > 0, F.coalesce(gain, F.lit(0.0)) / loss).otherwise(F.lit(float("inf")))).alias("profit_factor"),
        F.coalesce(F.min("__dd"), F.lit(0.0)).alias("max_drawdown"), F.avg("mae_pct").alias("mean_mae"), F.avg("mfe_pct").alias("mean_mfe"),
    )
    middle = quantiles(trades, {"median_r": ("pnl_r", 0.5), "__bars": ("bars", 0.5)}, by)
    if by:  # as structs, null groups meet
        group = F.struct(F.lit(0).alias("__0"), *by)
        out = out.withColumn("__group", group).join(middle.withColumn("__group", group).drop(*by), "__group")
    else:
        out = out.join(F.broadcast(middle))  # one row
    out = out.withColumn("median_hours", F.col("__bars") * hours_per_bar)
    return out.select(*by, "n_trades", "win_rate", "total_return", "mean_r", "median_r", "total_r", "profit_factor", "max_drawdown", "mean_mae", "mean_mfe", "median_hours")


def breakdown(trades: DataFrame, *by: str) -> DataFrame:
    """Count, win rate, mean and total R per group, nulls a group of their own;
    best total first.  A missing column raises ``KeyError``."""
    from ..schema import require_columns

    require_columns(trades, *by)
    return trades.groupBy(*by).agg(
        F.count("*").alias("n_trades"), F.avg((F.col("pnl_pct") > 0).cast("double")).alias("win_rate"), F.avg("pnl_r").alias("mean_r"), F.sum("pnl_r").alias("total_r")
    ).orderBy(F.desc("total_r"))


def by_year(trades: DataFrame) -> DataFrame:
    return breakdown(trades.withColumn("year", F.year("exit_ts")), "year")


def threshold_shares(trades: DataFrame, value: str = "mfe_atr", unit: float = 1.5, marks: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0, 3.0)) -> DataFrame:
    """Share of trades whose ``value / unit`` reaches each mark, in one pass."""
    return trades.agg(*[F.avg((F.col(value) / unit >= m).cast("double")).alias("reached_" + f"{m:g}".replace(".", "_")) for m in marks])


def acceptance(trades: DataFrame, accepted: str, label: str) -> DataFrame:
    """Count, mean R, win rate and profit factor on R of the accepted trades."""
    rows = trades.where(F.col(accepted))
    gain, loss = F.sum(F.when(F.col("pnl_r") > 0, F.col("pnl_r"))), F.sum(F.when(F.col("pnl_r") < 0, -F.col("pnl_r")))
    return rows.agg(F.lit(label).alias("label"), F.count("*").alias("n"), F.avg("pnl_r").alias("mean_r"), F.avg((F.col("pnl_r") > 0).cast("double")).alias("win_rate"), F.try_divide(gain, loss).alias("profit_factor"))


def weighted(trades: DataFrame, weight: str) -> DataFrame:
    """Mean R, profit factor, win rate and largest weight with weights scaled
    to a mean of 1."""
    mean = trades.agg(F.avg(weight).alias("__mean"))  # one row
    rows = trades.join(F.broadcast(mean)).withColumn("__r", F.col("pnl_r") * F.col(weight) / F.col("__mean"))
    gain, loss = F.sum(F.when(F.col("__r") > 0, F.col("__r"))), F.sum(F.when(F.col("__r") < 0, -F.col("__r")))
    return rows.agg(
        F.avg("__r").alias("mean_r"), F.try_divide(gain, loss).alias("profit_factor"), F.avg((F.col("pnl_r") > 0).cast("double")).alias("win_rate"), F.max(F.col(weight) / F.col("__mean")).alias("max_weight")
    )


def capture(trades: DataFrame, offered: str = "mfe_r") -> DataFrame:
    """Mean R, mean R on offer, and the share of it that was kept."""
    mean, on_offer = F.avg("pnl_r"), F.avg(offered)
    return trades.agg(mean.alias("mean_r"), on_offer.alias("offered_r"), F.try_divide(mean, F.nullif(on_offer, F.lit(0.0))).alias("captured"))


def beaten_share(samples: DataFrame, real: float, value: str = "mean_value") -> DataFrame:
    """Share of the samples that are below ``real``."""
    return samples.agg(F.avg((F.col(value) < real).cast("double")).alias("share_below"))


def control_summary(runs: DataFrame, real: float, value: str = "mean_r") -> DataFrame:
    """Mean, least and most of the control runs, and how many reach ``real``."""
    return runs.agg(F.count("*").alias("n_runs"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.sum((F.col(value) >= real).cast("int")).alias("n_reaching"))


def worst_of(results: DataFrame, config: list[str], value: str = "mean_r", count: str = "n_trades", least: int = 15) -> DataFrame:
    """Configurations by the worst of their parts: ``worst``, all trades, and
    whether every part has at least ``least`` of them; best first."""
    return results.groupBy(*config).agg(F.min(value).alias("worst"), F.sum(count).alias("n_trades"), F.bool_and(F.col(count) >= least).alias("valid")).orderBy(F.desc("valid"), F.desc("worst"))


def resampled(trades: DataFrame, runs: int = 400, seed: int = 7, value: str = "pnl_r", row: str = "seq") -> DataFrame:
    """``run, mean_value``: means of ``runs`` samples with replacement, drawn as
    Poisson(1) counts from a hash, so no row is collected or looked up; the same
    on every machine."""
    key = F.concat_ws("/", F.lit(str(seed)), F.col("run").cast("string"), F.col(row).cast("string"))
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    steps, total, p = F.lit(0), 0.0, 2.718281828459045**-1
    for k in range(8):
        total += p
        steps = steps + F.when(u >= total, 1).otherwise(0)
        p /= k + 1
    drawn = trades.select(row, value).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).withColumn("times", steps)
    return drawn.groupBy("run").agg(F.try_divide(F.sum(F.col(value) * F.col("times")), F.sum("times").cast("double")).alias("mean_value"))


def formatted(summary_row: dict, name: str) -> str:
    """A summary as a block of text."""
    return "\n".join([name, *(f"  {k:<14} {v:.4f}" if isinstance(v, float) else f"  {k:<14} {v}" for k, v in summary_row.items())])


def formatted_breakdown(title: str, rows: list[dict], group: str) -> str:
    """Rows of ``breakdown`` as a block of text."""
    head = f"  {'group':<16}{'trades':>8}{'wins':>9}{'mean R':>10}{'total R':>10}"
    body = [f"  {row[group]!s:<16}{row['n_trades']:>8}{row['win_rate']:>9.1%}{row['mean_r']:>10.3f}{row['total_r']:>10.1f}" for row in rows]
    return "\n".join([title, *([head, *body] if rows else ["  no trades"])])
