"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed to one weight per cell (source, language, topic).  The
cells are then raked: over and over, the weights of each level of a dimension
are scaled to that level's target, one dimension after the other, which
converges to the table closest to the data that has all target marginals.  A
document is sampled with the probability its cell's calibrated weight asks
for.  Everything is DataFrame operations; the cells are few (levels multiply,
documents do not) and the documents are never exchanged for their texts.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, quoted

DIMS = ("source", "lang", "topic")


@dataclass(frozen=True)
class MixParams:
    """``targets``: weight by level, by dimension; a dimension without them is
    aimed at its own token shares to the power ``temper``, which lifts small
    levels.  A level that ``targets`` do not name keeps its own share.
    ``tolerance``: raking goes on until every marginal is as close as that to
    its target; then the budget is lowered, if it must be, to the largest one
    that no cell needs a probability above 1 for, so that the sample's expected
    shares are the targets.  Targets that cannot be reached are warned of, and
    so is a lowered budget.  The level that is lifted most sets it: where
    ``temper`` lifts a level ten times, a tenth of the tokens is sampled at most;
    1 keeps the shares of dimensions without targets.
    ``rounds``: with ``tolerance=None``, raking takes just so many rounds, and
    probabilities are cut off at 1 whatever the shares become.
    ``budget``: share of all tokens to sample.  ``seed``: changes the draw."""

    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    temper: float = 0.8
    tolerance: float | None = 1e-7
    rounds: int = 6
    budget: float = 0.8
    seed: str = "mix"


def topic_of(text: Column) -> Column:
    """A coarse topic from a text's form: ``table`` (a bar in at least one of
    50 characters), ``data`` (an ASCII digit likewise), ``symbols`` (one of
    ``#*$%&``), ``list`` (line breaks in at least one of 60), else ``prose``.
    Null or empty text is ``prose``."""
    n = F.char_length(text)
    without = lambda marks: n - F.char_length(F.translate(text, marks, ""))
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "prose")
        .when(without("|") * 50 >= n, "table").when(without("0123456789") * 50 >= n, "data")
        .when(without("#*$%&") * 50 >= n, "symbols").when(without("\n") * 60 >= n, "list").otherwise("prose")
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``doc_id, source, lang, topic, tokens``; a token is a stretch of
    characters after a blank or line break, an empty text has none.  Null
    levels are the level ``unknown``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    level = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit("unknown"))
    blanks = F.char_length(text) - F.char_length(F.translate(text, " \n", ""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), level(source_col).alias("source"), level(lang_col).alias("lang"), topic_of(text).alias("topic"),
        F.when(text == "", 0).otherwise(blanks + 1).cast("long").alias("tokens"),
    )


def target_shares(cells: DataFrame, dim: str, params: MixParams) -> DataFrame:
    """``<dim>, share``: the target of every level of ``dim`` in ``cells``, summing to 1."""
    total = Window.partitionBy(F.lit(1))  # levels of one dimension only
    level = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t")).withColumn("own", F.try_divide("t", F.sum("t").over(total)))
    if given := params.targets.get(dim):
        wish = F.coalesce(F.create_map(*[F.lit(x) for kv in given.items() for x in kv])[F.col(dim)], F.col("own"))
    else:
        wish = F.pow("own", F.lit(params.temper))
    if params.tolerance is not None:
        wish = F.when(F.col("t") > 0, wish).otherwise(0.0)  # a level without tokens has no share to give
    return level.withColumn("wish", wish).select(dim, F.try_divide("wish", F.sum("wish").over(total)).alias("share"))


#: Fixed value: rounds in which the largest gap must fall by a tenth.
STALL = 10


def _gap(full: DataFrame) -> float:
    """The largest distance of a level's weights from its target share."""
    level = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("level"), F.col(f"to_{d}").alias("to"), "weight") for d in DIMS]))
    sums = full.select(level.alias("x")).select("x.*").groupBy("dim", "level").agg(F.sum("weight").alias("w"), F.first("to").alias("to"))
    return sums.agg(F.max(F.abs(F.col("w") - F.col("to")))).first()[0] or 0.0


def rake(cells: DataFrame, params: MixParams | None = None) -> DataFrame:
    """``cells`` (the dimensions and ``tokens``) with ``weight``: raked so that
    each level's weights sum to its target share.  Cells without tokens stay
    at weight 0; a level whose cells are all empty cannot be raised.  Warns of
    targets that no weights can meet together."""
    p = params or MixParams()
    full = cells
    for dim in DIMS:
        full = full.join(target_shares(cells, dim, p).withColumnRenamed("share", f"to_{dim}"), dim)
    full = cut(full.withColumn("weight", F.col("tokens").cast("double")))
    gaps: list[float] = []
    while len(gaps) < p.rounds or p.tolerance is not None:
        for dim in DIMS:
            # over cells, not documents; a window keeps the plan of a round in one line
            now = F.sum("weight").over(Window.partitionBy(dim))
            full = full.withColumn("weight", F.coalesce(F.col("weight") * F.try_divide(F.col(f"to_{dim}"), now), F.lit(0.0)))
        full = cut(full)  # keeps the plan of a round small
        if p.tolerance is None:
            gaps.append(0.0)
            continue
        gaps.append(_gap(full))
        if gaps[-1] <= p.tolerance:
            break
        if len(gaps) > STALL and gaps[-1] > 0.9 * gaps[-1 - STALL]:
            warnings.warn(f"mixing targets contradict each other or have no exact solution: after {len(gaps)} rounds a share is still off by {gaps[-1]:.3g}", stacklevel=2)
            break
    return full.select(*DIMS, "tokens", "weight")


def uniform(ident: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on ``ident`` and ``seed`` alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(ident.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, params: MixParams | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per input row: ``doc_id, source, lang, topic, tokens,
    probability, sampled``.

    ``probability`` is ``budget * all tokens * weight / tokens of the cell``,
    at most 1, rounded to 6 places; see ``MixParams`` for the budget.  Null
    identifiers all draw the same number, as do repeated rows.  Documents without tokens take their cell's
    probability; a cell without any token has probability 0.  An empty table
    gives an empty result.  Other columns are ignored.
    """
    p = params or MixParams()
    rows = cut(measured(docs, id_col, text_col, source_col, lang_col))
    raked = rake(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), p)
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    asked = F.try_divide(F.lit(p.budget) * all_tokens * F.col("weight"), F.col("tokens"))
    if p.tolerance is not None:
        # one number over the written cells
        highest = raked.agg(F.lit(p.budget) * F.sum("tokens") * F.max(F.try_divide("weight", "tokens"))).first()[0] or 0.0
        if highest > 1 + p.tolerance:
            warnings.warn(f"the budget is lowered from {p.budget:.3g} to {p.budget / highest:.3g} of all tokens, or a cell would need a probability of {highest:.3g}", stacklevel=2)
        asked = asked / max(1.0, highest)
    odds = F.round(F.least(F.lit(1.0), F.coalesce(asked, F.lit(0.0))), 6)
    cells = raked.select(*DIMS, odds.alias("probability"))
    # cells are bounded by the product of the level counts; Spark broadcasts
    # them only while they are below its own size limit
    return rows.join(cells, list(DIMS)).withColumn("sampled", uniform(F.col("doc_id"), p.seed) < F.col("probability")).select("doc_id", *DIMS, "tokens", "probability", "sampled")


def sampled(docs: DataFrame, params: MixParams | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples; same columns.  The decision is
    a cell's probability and the row's own hash, so texts are not exchanged
    unless there are too many cells to broadcast.

    Null levels are the level ``unknown``; null, empty and repeated rows and
    null identifiers fare as in ``mix``; an empty table gives an empty result."""
    p = params or MixParams()
    levels = [f"__{d}" for d in DIMS]
    cells = cut(mix(docs, p, id_col, text_col, source_col, lang_col).select(*[F.col(d).alias(f"__{d}") for d in DIMS], F.col("probability").alias("__p")).distinct())
    level = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit("unknown"))
    marked = docs.withColumns(dict(zip(levels, (level(source_col), level(lang_col), topic_of(F.coalesce(F.col(quoted(text_col)), F.lit("")))))))
    return marked.join(cells, levels).where(uniform(F.col(quoted(id_col)), p.seed) < F.col("__p")).select(*[docs[quoted(c)] for c in docs.columns])
