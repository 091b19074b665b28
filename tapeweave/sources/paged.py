"""A data source over downloads that arrive in pages.

A venue gives at most so many candles for one request, so a download is a run
of pages, each beginning behind the last.  They are kept as they came::

    <path>/symbol_dir=<symbol>/run=<number>/page=<number>/*.parquet

A run ends with its first page that is short (fewer rows than the limit), or
that does not advance (its last time is not beyond the one before): that page
counts, what a faulty client wrote behind it does not.  Every page is one
partition; pages of other symbols and other times are not opened but for their
footers.  As a stream, the offset of a symbol is the last page it has given.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.window import Window

from ..schema import OHLCV
from .store import safe_name

SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, run int, page int, place int"


@dataclass
class Page(InputPartition):
    """One page of one run: its files, rows, and first and last time."""

    symbol_dir: str
    run: int
    page: int
    files: tuple[str, ...]
    rows: int
    first: dt.datetime
    last: dt.datetime


def _pages(path: str, symbols: set[str] | None = None) -> list[Page]:
    """The pages that count, in order, from the names and footers of their files."""
    fs, base = pa.fs.FileSystem.from_uri(path)
    found: dict[tuple[str, int, int], list[str]] = {}
    folders = [x.path for x in fs.get_file_info(pa.fs.FileSelector(base, allow_not_found=True)) if x.base_name.startswith("symbol_dir=")]
    for folder in folders:
        symbol = folder.rsplit("=", 1)[1]
        if symbols is not None and symbol not in symbols:
            continue
        for info in fs.get_file_info(pa.fs.FileSelector(folder, recursive=True)):
            if info.type == pa.fs.FileType.File and info.path.endswith(".parquet"):
                run, page = (int(x.split("=")[1]) for x in info.path[len(folder) :].split("/")[1:3])
                found.setdefault((symbol, run, page), []).append(info.path)
    out = []
    for (symbol, run, page), files in sorted(found.items()):
        rows, ends = 0, []
        for name in files:
            with fs.open_input_file(name) as f:
                file = pq.ParquetFile(f)
                rows += file.metadata.num_rows
                ends += _ends(file)
        if rows:
            out.append(Page(symbol, run, page, tuple(files), rows, min(ends), max(ends)))
    return out


def _ends(file: pq.ParquetFile) -> list[dt.datetime]:
    """First and last time of a file: from its footer, or, where the kind of
    timestamp has no statistics, from that column."""
    at = file.metadata.schema.names.index("ts")
    found = [file.metadata.row_group(g).column(at).statistics for g in range(file.metadata.num_row_groups)]
    if all(x is not None and x.has_min_max for x in found):
        return [_utc(t) for x in found for t in (x.min, x.max)]
    ends = pc.min_max(file.read(["ts"])["ts"].cast(pa.timestamp("us", "UTC"))).as_py()
    return [ends["min"], ends["max"]] if ends["min"] is not None else []


def counted(pages: list[Page], limit: int) -> list[Page]:
    """Those up to and with the first short or unmoving page of their run."""
    out: list[Page] = []
    ended = before = None
    for p in pages:
        own = (p.symbol_dir, p.run)
        if own == ended:
            continue
        if before is None or (before.symbol_dir, before.run) != own:
            before = None
        out.append(p)
        if p.rows < limit or (before is not None and p.last <= before.last):
            ended = own
        before = p
    return out


def _rows(path: str, page: Page | None) -> Iterator[pa.RecordBatch]:
    if page is None:  # what Spark reads where there are no pages
        return
    fs, _ = pa.fs.FileSystem.from_uri(path)
    columns = ["symbol", "ts", *OHLCV, "place"]
    for name in page.files:
        with fs.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=columns):
                got = dict(zip(batch.schema.names, batch.columns, strict=True))
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [got["symbol"], got["ts"].cast(pa.timestamp("us", "UTC")), *[got[c] for c in OHLCV], pa.array([page.run] * n, pa.int32()), pa.array([page.page] * n, pa.int32()), got["place"].cast(pa.int32())],
                    names=["symbol", "ts", *OHLCV, "run", "page", "place"],
                )


class PagedCandles(DataSource):
    """``spark.read.format("paged_candles")`` with options ``path``, ``limit``."""

    @classmethod
    def name(cls) -> str:
        return "paged_candles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options["path"], int(self.options["limit"]))

    def streamReader(self, schema) -> PagedStream:  # noqa: N802
        return PagedStream(self.options["path"], int(self.options["limit"]), int(self.options.get("pages", "64")))


class PagedReader(DataSourceReader):
    """Pages as partitions.  Conditions on symbol and time, which Spark checks
    again on the rows, decide which pages are read at all."""

    def __init__(self, path: str, limit: int):
        self.path, self.limit = path, limit
        self.symbols: set[str] | None = None
        self.since = self.until = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("symbol",):
                own = {safe_name(s) for s in ([f.value] if isinstance(f, EqualTo) else f.value) if s is not None}
                self.symbols = own if self.symbols is None else self.symbols & own
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("ts",):
                self.since = _utc(f.value) if self.since is None else max(self.since, _utc(f.value))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("ts",):
                self.until = _utc(f.value) if self.until is None else min(self.until, _utc(f.value))
            yield f

    def partitions(self) -> list[Page]:
        pages = counted(_pages(self.path, self.symbols), self.limit)
        return [p for p in pages if (self.since is None or p.last >= self.since) and (self.until is None or p.first <= self.until)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        yield from _rows(self.path, partition)


class PagedStream(DataSourceStreamReader):
    """Pages behind the offset, at most ``pages`` of each symbol in one batch."""

    def __init__(self, path: str, limit: int, pages: int):
        self.path, self.limit, self.most = path, limit, pages
        self.given: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _behind(self, start: dict) -> dict[str, list[Page]]:
        out: dict[str, list[Page]] = {}
        for p in counted(_pages(self.path), self.limit):
            if [p.run, p.page] > start.get(p.symbol_dir, [-1, -1]):
                out.setdefault(p.symbol_dir, []).append(p)
        return out

    def latestOffset(self) -> dict:  # noqa: N802
        start = self.given or {}
        ends = {s: [own[: self.most][-1].run, own[: self.most][-1].page] for s, own in self._behind(start).items()}
        self.given = start | ends
        return dict(sorted(self.given.items()))

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.given = end if self.given is None else self.given
        return [p for own in self._behind(start).values() for p in own if [p.run, p.page] <= end.get(p.symbol_dir, [-1, -1])]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        yield from _rows(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


def _utc(t: dt.datetime) -> dt.datetime:
    return t.replace(tzinfo=dt.UTC) if t.tzinfo is None else t.astimezone(dt.UTC)


def land_pages(candles: DataFrame, path: str, limit: int, run: int = 0, arrival: list[str] | None = None) -> None:
    """Writes ``candles`` as the pages of one run, ``limit`` rows each, in the
    order of ``arrival`` (default: time)."""
    order = Window.partitionBy("symbol").orderBy(*(arrival or ["ts"]))
    placed = candles.withColumn("__n", F.row_number().over(order) - 1)
    pages = placed.select(
        "symbol", F.col("ts").cast("timestamp").alias("ts"), *[F.col(c).cast("double").alias(c) for c in OHLCV], (F.col("__n") % limit).cast("int").alias("place"),
        F.regexp_replace("symbol", r"[^A-Za-z0-9_.-]", "-").alias("symbol_dir"), F.lit(run).alias("run"), F.expr(f"CAST(__n div {limit} AS int)").alias("page"),
    )
    pages.repartition("symbol_dir", "page").write.mode("append").partitionBy("symbol_dir", "run", "page").parquet(path)


def read_pages(spark: SparkSession, path: str, limit: int, stream: bool = False, pages: int = 64) -> DataFrame:
    """Candles of all pages that count, with ``arrival``, their order of coming."""
    spark.dataSource.register(PagedCandles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = (spark.readStream if stream else spark.read).format("paged_candles").option("path", path).option("limit", limit).option("pages", pages)
    return source.load().withColumn("arrival", F.struct("run", "page", "place"))
