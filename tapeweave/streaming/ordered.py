"""Keyed state over a stream of bars, taken in the order of their time.

Bars wait in the state until the watermark has passed them: each sets a timer
at its own time, and timers go off in order, so a processor sees every series
as it happened, whatever order it came in.  What is too late by then is
dropped, and so is a bar whose time is already waiting.  State lives in the
stream's checkpoint below the shared folder; a restart goes on from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import shared_path

EVOLUTION = "symbol string, gap_id string, kind string, top double, bottom double, confirmed_at timestamp, ts timestamp, edge double, alive boolean"
PIVOTS = "symbol string, ts timestamp, close double, pivot_high boolean, pivot_low boolean"
#: The state store that holds timers and maps; a join has one of them a partition instead of four.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC)


class InOrder(StatefulProcessor):
    """Holds bars back until their time has passed; ``bar`` takes them one by one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "high double, low double, close double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in rows:
            if not self.waiting.containsKey((r.ms,)):
                self.waiting.updateValue((r.ms,), (r.high, r.low, r.close))
                self.handle.registerTimer(r.ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        ms = expiredTimerInfo.getExpiryTimeInMs()
        high, low, close = self.waiting.getValue((ms,))
        self.waiting.removeKey((ms,))
        yield from self.bar(key[0], ms, high, low, close)

    def bar(self, symbol: str, ms: int, high: float, low: float, close: float) -> Iterator[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class GapLives(InOrder):
    """Gaps born, worn and dead.  State: the last two bars, and every gap alive
    with what is left of it."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.past = handle.getListState("past", "high double, low double")
        self.alive = handle.getMapState("alive", "gap_id string", "kind string, top double, bottom double, confirmed long, worn double")

    def bar(self, symbol: str, ms: int, high: float, low: float, close: float) -> Iterator[Row]:
        for (gap_id,), (kind, top, bottom, confirmed, worn) in list(self.alive.iterator()):
            if ms < confirmed:
                continue
            bull = kind == "bullish"
            wick = low if bull else high
            worn = wick if worn is None else min(worn, wick) if bull else max(worn, wick)
            edge = min(top, max(bottom, worn))
            dead = edge <= bottom if bull else edge >= top
            if dead:
                self.alive.removeKey((gap_id,))
            else:
                self.alive.updateValue((gap_id,), (kind, top, bottom, confirmed, worn))
            yield Row(symbol=symbol, gap_id=gap_id, kind=kind, top=top, bottom=bottom, confirmed_at=_time(confirmed), ts=_time(ms), edge=edge, alive=not dead)
        past = list(self.past.get())
        if len(past) == 2:
            h1, l1 = past[0]
            new = ("bullish", low, h1) if low > h1 else ("bearish", l1, high) if high < l1 else None
            if new:
                self.alive.updateValue((f"{symbol}/{ms // 1000}",), (*new, ms + 1000 * self.seconds, None))
        self.past.put([*past[-1:], (high, low)])


class PivotMarks(InOrder):
    """Each bar with whether it is a pivot, ``n`` bars later.  State: the last
    ``2 n + 1`` closes."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.near = handle.getListState("near", "ms long, close double")

    def bar(self, symbol: str, ms: int, high: float, low: float, close: float) -> Iterator[Row]:
        n, near = self.n, [*self.near.get(), (ms, close)]
        if len(near) > n:
            at = len(near) - 1 - n
            sides = [x for k, (_, x) in enumerate(near) if k != at]
            own, whole = near[at][1], len(near) == 2 * n + 1
            yield Row(symbol=symbol, ts=_time(near[at][0]), close=own, pivot_high=whole and own > max(sides), pivot_low=whole and own < min(sides))
        self.near.put(near[-2 * n :])


def _processed(bars: DataFrame, processor: InOrder, schema: str, lateness: str) -> DataFrame:
    rows = bars.select("symbol", "ts", "high", "low", "close", F.unix_millis("ts").alias("ms")).withWatermark("ts", lateness)
    return rows.groupBy("symbol").transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def stream_gaps(bars: DataFrame, seconds: int, lateness: str = "1 hour") -> DataFrame:
    """``gaps.evolution`` of a stream of bars (``symbol, ts, high, low, close``):
    a row for every gap alive at every bar the watermark has passed."""
    return _processed(bars, GapLives(seconds), EVOLUTION, lateness)


def stream_pivots(bars: DataFrame, n: int = 3, lateness: str = "1 hour") -> DataFrame:
    """``structure.pivots`` of a stream of bars, each bar given out once the
    ``n`` bars behind it have been passed by the watermark."""
    return _processed(bars, PivotMarks(n), PIVOTS, lateness)


def _width(span: str) -> Column:
    """The length of ``span`` in microseconds."""
    return F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {span})")


def _start(ts: str, span: str) -> Column:
    """Where the stretch of length ``span`` that ``ts`` lies in begins."""
    return F.unix_micros(ts) - F.pmod(F.unix_micros(ts), _width(span))


def stream_asof(bars: DataFrame, rates: DataFrame, values: list[str], within: str, lateness: str = "1 hour", late_rates: str | None = None, slot: str = "1 hour") -> DataFrame:
    """Bars with the ``values`` of the last row of ``rates`` at or before them
    and less than ``within`` old, as streams.

    Of the rates of a ``slot`` of time only the last counts for bars of later
    slots, so these meet one row a slot; only bars and rates of one slot meet
    one by one.  ``slot`` should be about the time between two bars.  Keys are
    a symbol and a stretch of time, so a symbol's state is spread as well.

    Both sides have watermarks (``late_rates`` if the rates' differs), and a bar
    meets the rates of a bounded time, so the state of the join is bounded too.
    A bar comes out when no rate for it can come any more and ``within`` has
    passed too (Spark gives out what a join made that late); a rate whose slot
    has passed its watermark is left out.
    """
    key = lambda fine, start: F.struct(F.lit(fine).alias("fine"), start.alias("start"))
    near, before = _start("ts", slot), _start("ts", within)
    left = bars.withWatermark("ts", lateness).withColumn("__place", F.explode(F.array(key(True, near), key(False, before), key(False, before - _width(within)))))
    paid = rates.select(F.col("symbol").alias("r_symbol"), F.col("ts").alias("r_ts"), F.struct(*values).alias("r_values")).withWatermark("r_ts", late_rates or lateness)
    # r_at is the time that watermarks go by: a rate's own, or the end of its slot
    each = paid.select("r_symbol", F.col("r_ts").alias("r_at"), F.unix_micros("r_ts").alias("r_us"), "r_values").withColumn("r_place", key(True, _start("r_at", slot)))
    ends = paid.groupBy("r_symbol", F.window("r_ts", slot).alias("w")).agg(F.max(F.unix_micros("r_ts")).alias("r_us"), F.max_by("r_values", "r_ts").alias("r_values"))
    ends = ends.select("r_symbol", F.window_time("w").alias("r_at"), "r_us", "r_values").withColumn("r_place", key(False, _start("r_at", within)))
    met = left.join(
        each.unionByName(ends),
        F.expr(f"symbol = r_symbol AND __place = r_place AND r_at <= ts AND r_at > ts - INTERVAL {within}") & (F.col("r_us") > F.unix_micros("ts") - _width(within)),
        "leftOuter",
    )
    own = [c for c in bars.columns if c not in ("symbol", "ts")]
    last = met.groupBy("symbol", F.window("ts", "1 second").alias("w"), F.unix_micros("ts").alias("__us")).agg(*[F.first(c).alias(c) for c in own], F.max("ts").alias("ts"), F.max_by("r_values", "r_us").alias("r"))
    return last.select("symbol", "ts", *own, *[F.col(f"r.{v}").alias(v) for v in values])


def run(spark: SparkSession, stream: DataFrame, folder: str | None = None, partitions: int | None = None) -> DataFrame:
    """Everything ``stream`` has now, as a Parquet table in ``folder`` (one below
    ``spark.checkpoint.dir`` by default), which also has its checkpoint: run
    again on the same folder, it goes on from there.

    State is dealt in ``partitions`` when a folder is first used, and stays so.
    Each costs files in every batch, rows or none, so by default they are twice
    the cores, 16 at least, but no more than ``spark.sql.shuffle.partitions``.
    """
    folder = folder or shared_path(spark, "stream")
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = STATE | {"spark.sql.shuffle.partitions": str(partitions or min(most, max(16, 2 * spark.sparkContext.defaultParallelism)))}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        sink = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
        sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
