"""Where a series first does something: a tree of extremes as rows.

Bars are cut into nodes of ``FAN`` bars, these into nodes of ``FAN`` nodes, and
so on; a node is one row with the extremes of each of its children.  To find
the first bar at or after a place that reaches a price, a search reads the rest
of its own node, then of the node above, until a child can hold such a bar, and
goes down into it: two rows a level, so ``2 log n / log FAN`` in all, by
equi-joins on (series, node).  Nothing is paired with the bars between.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import written

FAN = 64
#: Rows that have nothing to look up at a level get keys of their own that no
#: node has, so that they spread.
_SPREAD = 4096


@dataclass(frozen=True)
class Tree:
    """``levels[k]`` has nodes of ``fan ** (k + 1)`` bars: ``key, node, kids``;
    ``kids`` are structs with ``at`` (place in the node) and the extremes.  The
    last level has one node for each series."""

    key: str
    fan: int
    levels: list[DataFrame]


def build(bars: DataFrame, extremes: dict[str, str], leaf: list[str] | None = None, key: str = "symbol", fan: int = FAN) -> Tree:
    """A tree over ``bars`` (``key, pos`` from 0 without holes, and columns).

    ``extremes`` names columns and which extreme of each, ``min`` or ``max``, a
    node keeps; ``leaf`` names further columns that the bars alone keep.
    """
    fold = {"min": F.min, "max": F.max}
    levels, at, held = [], F.col("pos"), [*extremes, *(leaf or [])]
    below = bars.select(key, "pos", *held)
    while True:
        kids = F.array_sort(F.collect_list(F.struct((at % fan).cast("int").alias("at"), *held))).alias("kids")
        level = written(below.groupBy(key, F.expr(f"{'pos' if not levels else 'node'} div {fan}").alias("node")).agg(kids, *[fold[kind](c).alias(c) for c, kind in extremes.items()]))
        levels.append(level.select(key, "node", "kids"))
        if level.where("node > 0").isEmpty():
            return Tree(key, fan, levels)
        below, at, held = level.select(key, "node", *extremes), F.col("node"), list(extremes)


def _read(state: DataFrame, tree: Tree, level: int, node: Column) -> DataFrame:
    """``state`` with the ``kids`` of a node of ``level``; none where ``node`` is null."""
    found = tree.levels[level].select(F.col(tree.key).alias("__key"), F.col("node").alias("__node"), F.col("kids").alias("__kids"))
    aside = F.coalesce(node, F.pmod(F.xxhash64("__start", tree.key), F.lit(_SPREAD)) - F.lit(_SPREAD) - 1)
    state = state.withColumn("__want", aside)
    return state.join(found, (F.col(tree.key) == F.col("__key")) & (F.col("__want") == F.col("__node")), "left").drop("__key", "__node")


def _search(queries: DataFrame, tree: Tree, test: Callable[[Column, bool], Column], back: bool) -> DataFrame:
    """One way up and down from ``__start``; adds ``__child`` (the bar found) and
    ``__again`` (where to go on if a node promised what its bars don't hold)."""
    fan, step = tree.fan, -1 if back else 1
    null = F.lit(None).cast("long")
    # __at: child to look from at this level, __child: child found, of level __level
    state = queries.withColumns({"__at": F.col("__start").cast("long"), "__child": null, "__level": F.lit(None).cast("int"), "__again": null})

    def hit(level: int, since: Column) -> Column:
        # ``since`` must be no column that the same projection replaces: inside a
        # lambda its name would mean the new one
        kids = F.filter("__kids", lambda k: F.coalesce(((k["at"] <= since) if back else (k["at"] >= since)) & test(k, level == 0), F.lit(False)))
        return F.get(kids, F.size(kids) - 1 if back else F.lit(0))["at"].cast("long")

    for level in range(len(tree.levels)):
        looking = F.col("__child").isNull() & (F.col("__at") >= 0)
        node = F.when(looking, F.floor(F.col("__at") / fan))
        state = _read(state, tree, level, node).withColumn("__off", F.pmod(F.col("__at"), F.lit(fan)))
        own = F.col("__want") * fan + hit(level, F.col("__off"))
        found = looking & own.isNotNull()
        state = state.withColumns({
            "__child": F.when(found, own).otherwise(F.col("__child")), "__level": F.when(found, level).otherwise(F.col("__level")),
            "__at": F.when(looking, F.col("__want") + step).otherwise(F.col("__at")),
        }).drop("__kids", "__want", "__off")
    for level in reversed(range(len(tree.levels) - 1)):
        inside = F.col("__child").isNotNull() & (F.col("__level") == level + 1)
        state = _read(state, tree, level, F.when(inside, F.col("__child")))
        own = F.col("__want") * fan + hit(level, F.lit(fan if back else 0))
        beyond = (F.col("__want") * fan ** (level + 1) - 1) if back else (F.col("__want") + 1) * fan ** (level + 1)
        state = state.withColumns({
            "__child": F.when(inside, own).otherwise(F.col("__child")), "__level": F.when(inside, level).otherwise(F.col("__level")),
            "__again": F.when(inside & own.isNull(), beyond).otherwise(F.col("__again")),
        }).drop("__kids", "__want")
    return state.drop("__at", "__level")


def first_passage(queries: DataFrame, tree: Tree, start: Column, test: Callable[[Column, bool], Column], out: str = "found", back: bool = False, exact: bool = True) -> DataFrame:
    """``queries`` with ``out``: the first bar at or after ``start`` (``back``:
    the last at or before it) that passes ``test``, null if none does.

    ``test(extremes, leaf)`` may use columns of the queries; for a node it must
    hold if it does for any of its bars.  If it may also hold where it does for
    none, ``exact`` is false, and searches go on behind such nodes, in as many
    rounds as one search meets of them.
    """
    state = _search(queries.withColumn("__start", start), tree, test, back)
    if exact:
        return state.withColumnRenamed("__child", out).drop("__start", "__again")
    done, columns = None, [*queries.columns, "__child"]
    while True:
        state = written(state)
        settled = state.where("__again IS NULL").select(*columns)
        done = settled if done is None else done.unionByName(settled)
        if state.where("__again IS NOT NULL").isEmpty():
            return done.withColumnRenamed("__child", out)
        state = _search(state.where("__again IS NOT NULL").withColumn("__start", F.col("__again")).select(*queries.columns, "__start"), tree, test, back)


def every_passage(queries: DataFrame, tree: Tree, since: Column, test: Callable[[Column, bool], Column]) -> DataFrame:
    """Each query with each bar from ``since`` on that passes ``test``: adds
    ``bar`` (the bar's ``at`` and columns) and ``pos``.  Goes down from the root
    into the children that can hold one."""
    state = queries.withColumns({"__since": since.cast("long"), "__start": F.lit(0), "pos": F.lit(0).cast("long")})
    for level in reversed(range(len(tree.levels))):
        state = _read(state, tree, level, F.col("pos"))
        kids = F.filter("__kids", lambda k: F.coalesce(((F.col("__want") * tree.fan + k["at"] + 1) * tree.fan**level > F.col("__since")) & test(k, level == 0), F.lit(False)))  # noqa: B023
        state = state.withColumn("bar", F.explode(kids)).withColumn("pos", F.col("__want") * tree.fan + F.col("bar.at")).drop("__kids", "__want")
        state = state if level == 0 else state.drop("bar")
    return state.drop("__since", "__start")
