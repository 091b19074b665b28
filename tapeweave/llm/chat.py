"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations.

Chat services log a conversation again after every turn, so logs hold many
prefixes of the same conversation.  Each turn gets a hash of all turns up to
it: a running sum of per-turn hashes that include the position.  A conversation
whose whole-length hash is the hash of a proper prefix of another one is an
older snapshot and goes (an anti-join); of equal conversations the smallest
identifier stays.  What is left is rendered.

Running sums and rendering work in blocks of ``BLOCK`` turns: windows, groups
and joins of turns are keyed by (conversation, block), and the per-block totals
that link them are ``BLOCK`` times fewer rows, so one endless conversation
spreads out.

Prefixes are compared by their length and four sums of 32-bit pieces of two
64-bit hashes a turn, not by their texts: two different prefixes of one length
agree by chance with probability about 2^-128, so among 10^12 logged prefixes
any such pair has a chance below 10^-14.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Turns per block, and at most so many turns per rendered part.
BLOCK = 256
#: Parts of the hash: two 64-bit hashes cut in 32-bit pieces, so that sums of
#: fewer than 2^31 turns fit a long.
PARTS = ("h1", "h2", "h3", "h4")


def _running(turns: DataFrame, key: list[str], values: list[str], totals_of: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``r_<value>``: the sum of each value over this and earlier blocks'
    and this block's earlier rows, in the order of ``turn, tie``; and for
    ``totals_of`` also ``all_<value>``, the sum over all blocks."""
    near = Window.partitionBy(*key, "block").orderBy("turn", "tie").rowsBetween(Window.unboundedPreceding, 0)
    inner = turns.withColumns({f"r_{v}": F.sum(v).over(near) for v in values})
    totals = turns.groupBy(*key, "block").agg(*[F.sum(v).alias(f"t_{v}") for v in values])
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(
        *key, "block", *[F.coalesce(F.sum(f"t_{v}").over(before), F.lit(0)).alias(f"b_{v}") for v in values], *[F.sum(f"t_{v}").over(Window.partitionBy(*key)).alias(f"all_{v}") for v in totals_of]
    )
    joined = inner.join(heads, [*key, "block"])
    return joined.withColumns({f"r_{v}": F.col(f"r_{v}") + F.col(f"b_{v}") for v in values}).drop(*[f"b_{v}" for v in values])


def prefix_hashes(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: ``conv, turn, tie, block, role, text``, its position
    ``r_one`` (from 1), ``all_one`` (turns of its conversation) and the hash
    parts ``r_h1 .. r_h4`` of the prefix that ends with it."""
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    # a null identifier or turn number cannot be placed in a conversation
    rows = rows.where("conv IS NOT NULL AND turn IS NOT NULL").distinct()
    rows = rows.withColumns({"block": F.expr(f"turn div {BLOCK}"), "tie": F.xxhash64("role", "text"), "one": F.lit(1).cast("long")})
    placed = _running(rows, ["conv"], ["one"], ("one",))
    first, second = F.xxhash64("r_one", "role", "text"), F.xxhash64(F.lit("second"), "text", "r_one", "role")
    low, high = F.lit(0xFFFFFFFF), 32
    hashed = placed.withColumns(
        {"h1": first.bitwiseAND(low), "h2": F.shiftrightunsigned(first, high), "h3": second.bitwiseAND(low), "h4": F.shiftrightunsigned(second, high)}
    )
    return _running(hashed, ["conv"], list(PARTS)).drop("one", *PARTS)


def collapse(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The hashed turns, and the maximal conversations ``conv, n_turns,
    n_copies`` among them."""
    hashed = cut(prefix_hashes(turns, id_col, turn_col, role_col, text_col))
    key = ["r_one", *[f"r_{p}" for p in PARTS]]
    whole = hashed.where("r_one = all_one").select("conv", *key)
    # distinct before the join: a first turn that very many share is one row
    prefixes = hashed.where("r_one < all_one").select(*key).distinct()
    unique = whole.groupBy(*key).agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    return hashed, unique.join(prefixes, key, "left_anti").select("conv", F.col("r_one").alias("n_turns"), "n_copies")


def chat_format(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Render the maximal conversations: ``conv_id, part, n_turns, n_copies, text``.

    Each turn reads ``<|role|>``, a line break, its text and ``<|end|>``; a
    ``<|`` inside a role or text becomes ``< |``, so no text can fake a mark.
    ``part`` counts from 0; a conversation with turn numbers beyond ``BLOCK``
    comes in several parts, to be read in order.  ``n_copies`` counts equal
    conversations, of which the smallest identifier is given.

    Null role or text: empty.  Null identifier or turn number: the row belongs
    to no conversation and is left out.  Repeated rows count once; different
    rows with one turn number stay, in the order of a hash of their content.
    An empty table gives an empty result.  Other columns are ignored.
    """
    hashed, kept = collapse(turns, id_col, turn_col, role_col, text_col)
    safe = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit("<|"), safe("role"), F.lit("|>\n"), safe("text"), F.lit("<|end|>\n"))
    # kept conversations by block (``BLOCK`` times fewer rows), then the turns by both
    blocks = hashed.select("conv", "block").distinct().join(kept, "conv")
    rows = hashed.join(blocks, ["conv", "block"]).select("conv", "block", "n_turns", "n_copies", F.struct("r_one", line.alias("line")).alias("row"))
    parts = rows.groupBy("conv", "block", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    first = Window.partitionBy("conv").orderBy("block")
    return parts.select(
        F.col("conv").alias("conv_id"), (F.row_number().over(first) - 1).cast("long").alias("part"), "n_turns", "n_copies", F.array_join("rows.line", "").alias("text")
    )
