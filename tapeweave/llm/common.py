"""Helpers that several text operators share: word splitting on Arrow buffers,
bounded batches, lineage cuts, hot-key joins and connected components."""

from __future__ import annotations

import sys
import tempfile
import uuid
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: White space that ends a word: space, and tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
#: Bytes of text that one step of a vectorised operator holds at once.  A
#: longer single text is a step of its own.
SLICE_BYTES = 1 << 20


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Its absence is an error on a cluster.  A session on one machine may leave it
    unset: its driver is its only executor, whose own folder then serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        warnings.warn("spark.checkpoint.dir is not set: a folder of this machine is used", stacklevel=2)
        base = f"{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/tapeweave-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that
    outlives any executor."""
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows whose ``column`` holds at most
    ``most`` bytes (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of a column of texts, as numpy arrays.

    ``data``/``starts``/``ends``: UTF-8 bytes and each word's place in them;
    ``first``: index of each text's first word (one more entry than texts).
    """

    def __init__(self, texts: pa.Array, lower: bool = False, split_marks: bool = False):
        """``split_marks``: also cut between an ASCII letter and an ASCII mark
        (neither white, letter, digit nor apostrophe)."""
        self.data, self.bounds = text_bytes(texts)
        data = self.data
        if lower:
            data = data.copy()
            data[(data >= 65) & (data <= 90)] += 32
            self.data = data
        white = np.ones(len(data) + 1, dtype=bool)
        np.less_equal(np.subtract(data, 9, dtype=np.uint8, casting="unsafe"), 4, out=white[:-1])
        white[:-1] |= data == 32
        word = ~white
        begins = word.copy()
        begins[1:] &= white[:-1]
        inner = self.bounds[1:-1]
        begins[inner] = word[inner]
        stops = white.copy()
        stops[inner] = True
        if split_marks:
            letter = np.subtract(data | 32, 97, dtype=np.uint8, casting="unsafe") < 26
            mark = (data > 32) & (data < 127) & (data != 39) & ~letter & ~((data >= 48) & (data <= 57))
            edge = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
            begins[1:-1] |= edge
            stops[1:-1] |= edge
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(word[:-1] & stops[1:]) + 1
        self.first = np.searchsorted(self.starts, self.bounds).astype(np.int64)
        self.white = white[:-1]

    def __len__(self) -> int:
        return len(self.starts)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def array(self) -> pa.Array:
        """All words as one Arrow array of strings."""
        kept = self.data[~self.white]
        offsets = np.zeros(len(self) + 1, dtype=np.int64)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        return pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(offsets), pa.py_buffer(kept))

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, and the distinct words."""
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def quoted(name: str) -> str:
    """A column's name as it may stand in an expression, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def entry_bytes(key: str, value: bytes) -> int:
    """What a remembered pair takes: both objects as Python holds them, and
    their place in a dictionary."""
    return sys.getsizeof(key) + sys.getsizeof(value) + 120


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (null: empty)."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or not len(offsets):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift) over uint64 values."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def join_by_key(rows: DataFrame, facts: DataFrame, key: str | list[str], size: str, total: int, share: int = 1000) -> DataFrame:
    """``rows`` inner-joined with one fact per ``key``, safe for hot keys.

    ``facts`` has, in ``size``, how many of the ``total`` rows carry its key.
    Keys with more than ``total / share`` rows number fewer than ``share`` by
    the pigeonhole principle, so they are broadcast whatever the data; the rest
    join by shuffle, where no key can bring more than that to a task.  Rows
    with a null key find no fact.
    """
    keys = [key] if isinstance(key, str) else key
    limit = max(1, total // share)
    hot = facts.where(F.col(size) > limit)
    cold = facts.where(F.col(size) <= limit)
    return (
        rows.join(F.broadcast(hot), keys)
        .unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))
    )


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node of ``edges(u, v)`` has one ``v`` at most, and none if
    it is a ``v`` itself: then each ``v`` is the root of its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.max("e.root").alias("root"))
    return nodes.where("ups + root > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)`` as ``(node, root)``, root being
    the smallest node reachable.

    Alternating large-star and small-star steps, until the edges are stars
    around their roots, which is checked on the edges themselves.  Every step
    is a grouped minimum (combined before the shuffle) and a join by the node,
    in which nodes with very many links meet their minimum by broadcast (see
    ``join_by_key``), so a hub's links stay spread.  Rounds grow with the
    logarithm of the component size; each is written to the shared folder.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _is_star_forest(now):
        # edges go from the larger node to the smaller; star steps keep that
        total = now.count()
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
        # only edges to larger nodes go on, but all links counted for the minimum
        large = cut(join_by_key(both.where("v > u"), least, "u", "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = join_by_key(large, low.where("n > 1"), "u", "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
