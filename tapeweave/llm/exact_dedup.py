"""Exact deduplication by a tree-merge of sorted digest runs.

Every input partition becomes one *run*: its entries ``(key, identifier,
count)`` in the order of their keys, one entry a key, packed into chunks.  In
each round the runs of ``fan`` neighbours (two: binomial rounds) are exchanged
and merged, until one run is left.  A round's exchange deals chunks by (run
group, slice of the key space), with more slices as the groups grow fewer, so
every round is spread over as many tasks as its entries fill.  A merge streams
through the chunks of its runs in the order of their first keys and holds one
unfinished chunk of each run at most.

A key is the text's SHA-256, its length and a second, independent 64-bit hash:
entries are one text only if all three agree, which every merge of every round
checks anew.  The identifier kept and the count go along through all levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_LOWER, ASCII_UPPER, cut, join_by_key, quoted

#: Bytes of a key: SHA-256, length, second hash.
KEY = 48
#: Entries per chunk, and entries that a slice of a group is meant to hold.
CHUNK, SLICE = 1 << 12, 1 << 18
RUNS = "run int, slice int, first binary, n int, keys binary, known binary, ids binary, counts binary"


def normalised(text: Column | str) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null is empty."""
    text = F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))
    # lower() is the same thing on ASCII, and faster
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key`` of every row."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    eight = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    return text.select("doc_id", F.concat(F.unhex(F.sha2("t", 256)), eight(F.octet_length("t").cast("long")), eight(F.xxhash64("t"))).alias("key"))


class Entries:
    """Entries in the order of their keys, one a key.

    ``keys`` fixed-width bytes, ``known`` whether there is an identifier,
    ``ids`` the best one, ``counts`` the rows behind it."""

    def __init__(self, keys: np.ndarray, known: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.keys, self.known, self.ids, self.counts = keys, known, ids, counts

    def __len__(self) -> int:
        return len(self.keys)

    def part(self, a: int, b: int) -> Entries:
        return Entries(self.keys[a:b], self.known[a:b], self.ids[a:b], self.counts[a:b])

    @staticmethod
    def merged(parts: list[Entries], largest: bool) -> Entries:
        """The parts, each in order, merged (a stable sort joins ordered
        stretches); entries of equal keys become one."""
        keys = np.concatenate([p.keys for p in parts])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        known, ids, counts = (np.concatenate([getattr(p, k) for p in parts])[order] for k in ("known", "ids", "counts"))
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        if len(heads) == len(keys):
            return Entries(keys, known, ids, counts)
        edge = np.iinfo(np.int64).min if largest else np.iinfo(np.int64).max
        best = (np.maximum if largest else np.minimum).reduceat(np.where(known, ids, edge), heads)
        return Entries(keys[heads], np.logical_or.reduceat(known, heads), best, np.add.reduceat(counts, heads))


def _unpacked(row: dict) -> Entries:
    return Entries(np.frombuffer(row["keys"], dtype=f"S{KEY}"), np.frombuffer(row["known"], dtype=bool), np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["counts"], dtype="<i8"))


def _slices(entries: Entries, bits: int) -> np.ndarray:
    """The leading ``bits`` bits of each key."""
    lead = np.frombuffer(entries.keys.tobytes(), dtype=np.uint8).reshape(-1, KEY)[:, :4].copy().view(">u4")[:, 0]
    return (lead.astype(np.int64) >> (32 - bits)) if bits else np.zeros(len(entries), dtype=np.int64)


class _Packer:
    """Collects ordered entries of one run and gives them out as chunks, each of
    one slice."""

    def __init__(self, run: int, bits: int):
        self.run, self.bits, self.held, self.size = run, bits, [], 0

    def add(self, entries: Entries) -> Iterator[pa.RecordBatch]:
        if len(entries):
            self.held.append(entries)
            self.size += len(entries)
            if self.size >= CHUNK:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        every = Entries(*(np.concatenate([getattr(e, k) for e in self.held]) for k in ("keys", "known", "ids", "counts")))
        self.held, self.size = [], 0
        where = _slices(every, self.bits)
        cuts = np.unique(np.concatenate(([0], np.flatnonzero(np.diff(where)) + 1, np.arange(0, len(every), CHUNK), [len(every)])))
        rows = [(self.run, int(where[a]), every.keys[a : a + 1].tobytes(), int(b - a), every.part(a, b)) for a, b in zip(cuts[:-1], cuts[1:])]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int32())
        arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
        arrays += [pa.array([np.ascontiguousarray(getattr(r[4], k)).tobytes() for r in rows], pa.binary()) for k in ("keys", "known", "ids", "counts")]
        yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in RUNS.split(", ")])


def _bits(entries: int, runs: int, fan: int) -> int:
    """Slices (as a power of two) for an exchange in which ``fan`` of ``runs``
    runs with ``entries`` entries in all meet."""
    groups = -(-runs // fan)
    return min(31, max(0, (entries // max(1, groups * SLICE)).bit_length()))


def sorted_runs(rows: DataFrame, bits: int, keep: str = "largest") -> DataFrame:
    """One run for each partition of ``rows`` (``doc_id, key``), as ``RUNS``.
    Spark sorts the partition; equal keys, which then follow each other, are
    combined as they stream by."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, open_entry = _Packer(TaskContext.get().partitionId(), bits), None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype=f"S{KEY}")
            ids = batch.column("doc_id")
            own = Entries(keys, ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), np.ones(len(keys), dtype=np.int64))
            own = Entries.merged([own] if open_entry is None else [open_entry, own], keep == "largest")
            yield from packer.add(own.part(0, len(own) - 1))
            open_entry = own.part(len(own) - 1, len(own))  # the next batch may go on with this key
        if open_entry is not None:
            yield from packer.add(open_entry)
        yield from packer.flush()

    return rows.sortWithinPartitions("key").mapInArrow(pack, RUNS)


def merge_round(runs: DataFrame, fan: int, tasks: int, bits: int, keep: str = "largest") -> DataFrame:
    """One round: runs ``fan * k`` to ``fan * k + fan - 1`` become run ``k``,
    with chunks cut for ``bits`` of the next exchange.  No runs give none."""
    largest = keep == "largest"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, at, pending = None, None, []
        for batch in batches:
            for row in batch.to_pylist():  # a row is a chunk
                here = (row["run"] // fan, row["slice"])
                if here != at:
                    if pending:
                        yield from packer.add(Entries.merged(pending, largest))
                    if packer is not None:
                        yield from packer.flush()
                    packer, at, pending = _Packer(here[0], bits), here, []
                # no chunk to come has a key below this one's first: what lies below is final
                if pending:
                    ready = Entries.merged(pending, largest)
                    done = int(np.searchsorted(ready.keys, np.frombuffer(row["first"], dtype=f"S{KEY}")[0], side="left"))
                    yield from packer.add(ready.part(0, done))
                    pending = [ready.part(done, len(ready))] if done < len(ready) else []
                pending.append(_unpacked(row))
        if pending:
            yield from packer.add(Entries.merged(pending, largest))
        if packer is not None:
            yield from packer.flush()

    group = F.expr(f"run div {fan}")
    dealt = runs.withColumn("group", group).repartition(tasks, "group", "slice").sortWithinPartitions("group", "slice", "first")
    return dealt.drop("group").mapInArrow(merge, RUNS)


def merge_runs(rows: DataFrame, total: int, keep: str = "largest", fan: int = 2, rounds: list[int] | None = None) -> DataFrame:
    """Sort ``rows`` (``doc_id, key``; ``total`` of them, written to storage)
    into runs and merge these, ``fan`` at a time, down to one entry a text:
    ``key, keep_id, group_size``.  ``rounds`` is given the number of rounds.

    Equal keys of any number of rows are one entry from their own partition on.
    A null identifier loses to any other; a text with none has a null
    ``keep_id``.  Empty ``rows`` give an empty result.
    """
    if fan < 2:
        raise ValueError("fan must be 2 or more")
    partitions = max(1, rows.rdd.getNumPartitions())
    runs = cut(sorted_runs(rows, _bits(total, partitions, fan), keep))
    # the written runs say how many there are, whatever plan made them
    left = (runs.agg(F.max("run")).first()[0] or 0) + 1
    sliced = _bits(total, partitions, fan)
    n = 0
    while True:
        n += 1
        entries, chunks = runs.agg(F.sum("n"), F.count("*")).first()
        groups = -(-left // fan)
        after = _bits(entries or 0, groups, fan)
        runs = cut(merge_round(runs, fan, max(1, min(chunks, groups << sliced)), after, keep))
        left, sliced = groups, after
        if left == 1:
            break
    if rounds is not None:
        rounds.append(n)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                e = _unpacked(row)
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY), len(e), [None, pa.py_buffer(row["keys"])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([keys, pa.array(e.ids, pa.int64(), mask=~e.known), pa.array(e.counts, pa.int64())], names=["key", "keep_id", "group_size"])

    return runs.mapInArrow(unpack, "key binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan: int = 2) -> DataFrame:
    """Group documents of equal text and name the one that stays.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``.  ``keep`` is ``largest`` or ``smallest`` identifier.  Runs are
    merged ``fan`` at a time; with two the rounds are binomial, as many as the
    logarithm of the runs to base two.

    Null or empty text: one group, like any other text.  Null identifier: loses
    to any other; a group with null identifiers only has a null ``keep_id`` and
    its rows are kept.  Repeated rows (same identifier and text) count in
    ``group_size`` and get the same answer.  Other columns are ignored.
    """
    rows = cut(digests(docs, id_col, text_col))
    total = rows.count()
    texts = cut(merge_runs(rows, total, keep, fan))
    return join_by_key(rows, texts, "key", "group_size", total).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``docs`` without all but one row of each group of equal texts; same columns.

    Null text is an empty text, a null identifier loses to any other.  Where
    the identifier that stays is on several rows of the group, the one with the
    least hash of all its columns (but maps, which have none) stays; rows equal
    in all of them are the same row.  An empty table gives an empty result.
    """
    key = lambda ident, digest: F.unhex(F.sha2(F.concat_ws("|", digest, F.coalesce(ident.cast("string"), F.lit("null"))), 256))
    kept = exact_dedup(docs, id_col, text_col, keep).where("kept").select(key(F.col("keep_id"), F.col("text_sha256")).alias("__key")).distinct()
    hashed = F.xxhash64(*[docs[quoted(f.name)] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    marked = docs.select("*", key(F.col(quoted(id_col)).cast("long"), F.sha2(normalised(F.col(quoted(text_col))), 256)).alias("__key"), hashed.alias("__hash"))
    # the join and the choice among repeated rows share one exchange of the texts;
    # each task passes on one row a key at most
    first = F.row_number().over(Window.partitionBy("__key").orderBy("__hash"))
    return marked.join(kept, "__key", "left_semi").withColumn("__n", first).where("__n = 1").select(*map(quoted, docs.columns))
