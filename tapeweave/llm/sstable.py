"""Token ids in sorted-string-table shards, and reading them back.

A shard file holds documents in ascending key order::

    block*   index   filter   footer

* A *block* (about 64 KiB before compression) is a run of entries
  ``shared, rest, value size`` (varints), the rest of the key, the value; each
  key leaves out the bytes it shares with the one before.  Blocks are
  Zstandard-compressed and carry a CRC-32.
* The *index* has each block's last key, place and size: binary search finds
  the one block that can hold a key.
* The *filter* is a Bloom filter over the keys.
* The *footer*, of fixed size, has the places of index and filter, the counts
  and the width of an id.

Keys are ``00`` for null or ``01`` and the identifier as eight big-endian bytes
with the sign bit turned, so byte order is identifier order.  Values are ids as
little-endian unsigned integers of 2 or 4 bytes.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, cut, entry_bytes, slices

MAGIC = b"TWSST001"
FOOTER = struct.Struct("<QQQQQQB7x8s")
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long, n_bytes long"


@dataclass(frozen=True)
class ShardParams:
    """``block_bytes``: entries per block, before compression.  ``shard_bytes``:
    a shard is closed once it is this large.  ``bloom_bits``: filter bits per
    key.  ``end_id``: appended to every document (None: nothing).
    ``task_bytes``: text that one writing task is meant to get."""

    block_bytes: int = 64 << 10
    shard_bytes: int = 32 << 20
    bloom_bits: int = 10
    end_id: int | None = 1
    task_bytes: int = 256 << 20


#: The normaliser and splitter of a tokenizer file whose words can
#: be encoded one by one.
BY_WORD = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)


def key_of(ident: int | None) -> bytes:
    return b"\0" if ident is None else b"\1" + struct.pack(">Q", (ident + (1 << 63)) & 0xFFFFFFFFFFFFFFFF)


def ident_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a = xxhash.xxh64_intdigest(key)
    b = xxhash.xxh64_intdigest(key, seed=1) | 1
    return [((a + k * b) & 0xFFFFFFFFFFFFFFFF) % bits for k in range(7)]


class ShardWriter:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, out, width: int, params: ShardParams):
        self.out, self.width, self.params = out, width, params
        self.at = self.n_docs = self.n_ids = 0
        self.block, self.last, self.index, self.keys = bytearray(), b"", [], []

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            shared = len(os.path.commonprefix([self.last, key]))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n_docs += 1
        self.n_ids += len(value) // self.width
        if len(self.block) >= self.params.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            packed = pa.compress(bytes(self.block), codec="zstd", asbytes=True)
            packed = struct.pack("<II", len(self.block), zlib.crc32(packed)) + packed
            self.index.append((self.last, self.at, len(packed)))
            self.out.write(packed)
            self.at += len(packed)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QI", at, size) for k, at, size in self.index)
        bits = max(64, -(-len(self.keys) * self.params.bloom_bits // 8) * 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index)
        self.out.write(bytes(bloom))
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.n_docs, self.n_ids, self.width, MAGIC))
        self.at += len(index) + len(bloom) + FOOTER.size
        self.out.close()


class ShardReader:
    """Looks up or iterates one shard through its footer, filter and index."""

    def __init__(self, path: str):
        fs, name = pa.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        end = self.file.size()
        at, n, bloom_at, bloom_n, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(self._read(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.bloom = self._read(bloom_at, bloom_n)
        raw, self.index, i = self._read(at, n), [], 0
        while i < len(raw):
            size, i = _read_varint(raw, i)
            self.index.append((raw[i : i + size], *struct.unpack_from("<QI", raw, i + size)))
            i += size + 12

    def _read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype=f"<u{self.width}").astype(np.uint32)

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size = self.index[block]
        packed = self._read(at, size)
        full, crc = struct.unpack_from("<II", packed)
        if zlib.crc32(packed[8:]) != crc:
            raise ValueError("a block's checksum is wrong")
        data = pa.decompress(packed[8:], decompressed_size=full, codec="zstd", asbytes=True)
        i, key = 0, b""
        while i < len(data):
            shared, i = _read_varint(data, i)
            rest, i = _read_varint(data, i)
            size, i = _read_varint(data, i)
            key = key[:shared] + data[i : i + rest]
            i += rest
            yield key, data[i : i + size]
            i += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self.index)):
            for key, value in self.entries(block):
                yield ident_of(key), self._ids(value)

    def get(self, ident: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier (none: empty list)."""
        key = key_of(ident)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.bloom) * 8)):
            return []
        out, block = [], bisect_left(self.index, key, key=lambda x: x[0])
        while block < len(self.index):
            found = [self._ids(v) for k, v in self.entries(block) if k == key]
            out += found
            if self.index[block][0] != key:
                break
            block += 1
        return out


class WordTokenizer:
    """Encodes whole texts with a tokenizer that lower-cases, drops white space
    and takes runs of letters and runs of marks apart before it merges: no
    token spans such a border, so each distinct piece is encoded once per batch
    and remembered in two generations of ``MOST`` bytes.  Pieces of more than
    ``WIDEST`` characters are not kept: in texts without white space a piece is
    a whole text.  Files with any other normaliser or splitter (``BY_WORD``)
    have their texts encoded whole."""

    MOST = 96 << 20
    WIDEST = 256

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        parts = json.loads(self.tokenizer.to_str())
        self.by_word = (parts.get("normalizer"), parts.get("pre_tokenizer")) == BY_WORD
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _keep(self, word: str, ids: bytes) -> None:
        if len(word) <= self.WIDEST:
            if self.held >= self.MOST:
                self.old, self.new, self.held = self.new, {}, 0
            self.new[word] = ids
            self.held += entry_bytes(word, ids)

    def _words(self, words: list[str]) -> list[bytes]:
        kind = "H" if self.width == 2 else "I"
        out = list(map(self.new.get, words))
        todo = []
        for i in [i for i, x in enumerate(out) if x is None]:
            got = self.old.get(words[i])
            if got is None:
                todo.append(i)
            else:
                out[i] = got
                self._keep(words[i], got)
        for at in range(0, len(todo), 5000):
            part = todo[at : at + 5000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False)):
                out[i] = array(kind, e.ids).tobytes()
                self._keep(words[i], out[i])
        return out

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's ids begin."""
        if not self.by_word:
            return self._whole(texts, end_id)
        words = Words(texts, lower=True, split_marks=True)
        raw = words.data.tobytes()
        if any(t in raw for t in self.special):  # a special token's own marks stay together
            words = Words(texts)
        codes, distinct = words.coded()
        each = self._words(distinct.to_pylist())
        kind = f"<u{self.width}"
        if end_id is not None:  # a word of its own at the end of each text
            each.append(np.array([end_id], dtype=kind).tobytes())
            codes = np.insert(codes, words.first[1:], len(each) - 1)
        first = words.first + np.arange(len(texts) + 1) * (end_id is not None)
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // self.width
        flat = np.frombuffer(b"".join(each), dtype=kind)
        n = sizes[codes]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return flat[at], np.concatenate(([0], ends))[first]


    def _whole(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        tail = [] if end_id is None else [end_id]
        lists = [np.array(e.ids + tail, dtype=f"<u{self.width}") for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.concatenate([*lists, np.zeros(0, dtype=f"<u{self.width}")]), np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, params: ShardParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and write shards of ascending identifiers to ``folder``.

    Returns the manifest (``MANIFEST``), written to the shared folder: it names
    the files of the attempts that succeeded, so what a lost executor leaves
    behind is never read.  ``tokenizer`` is the path of a ``tokenizers`` file.

    Null text: encoded as empty.  Null identifier: sorts first.  Repeated
    identifiers: all rows are written, equal ones in order of their text's
    hash.  An empty table gives an empty manifest.
    """
    p = params or ShardParams()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokenizer(tokenizer)
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part, tag, done, shard = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], [], None

        def close(writer: ShardWriter, name: str) -> None:
            writer.close()
            done.append((part, len(done), f"{folder}/{name}", writer.n_docs, writer.n_ids, writer.at))

        for batch in slices(batches, "text", 5 << 20):
            ids, bounds = coder.encode(batch.column("text"), p.end_id)
            raw, w = memoryview(ids.tobytes()), coder.width
            for ident, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                if shard is None:
                    name = f"part-{part:06d}-{len(done):04d}-{tag}.sst"
                    shard = ShardWriter(fs.open_output_stream(f"{base}/{name}"), w, p)
                shard.add(key_of(ident), bytes(raw[a * w : b * w]))
                if shard.at >= p.shard_bytes:
                    close(shard, name)
                    shard = None
        if shard is not None:
            close(shard, name)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
            names=["part", "seq", "path", "n_docs", "n_ids", "n_bytes"],
        )

    rows = docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"cast(`{text_col}` as string) AS text")
    # as many writers as the texts ask for, at every size
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // p.task_bytes))
    tie = F.xxhash64("text")  # one identifier may be on very many rows
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    return cut(ordered.mapInArrow(write, MANIFEST))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards in ``manifest``: ``doc_id, start, ids``;
    ``start`` is the number of ids of all documents before it."""
    return _scan(manifest, "doc_id long, start long, ids array<long>", lambda ids: pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))


def shard_digests(manifest: DataFrame) -> DataFrame:
    """As ``read_shards``, but with ``n_tokens`` and the CRC-32 of the ids as
    little-endian unsigned 32-bit integers in place of the ids."""

    return _scan(
        manifest, "doc_id long, start long, n_tokens long, ids_crc32 long",
        lambda ids: pa.array([len(x) for x in ids], pa.int64()), lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
    )


def _scan(manifest: DataFrame, schema: str, *columns) -> DataFrame:
    # two levels, so that only one row per partition meets in one place
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = manifest.join(before, "part").withColumn("start", F.col("before") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = ShardReader(path)
                for block in range(len(shard.index)):
                    entries = list(shard.entries(block))
                    ids = [shard._ids(v) for _, v in entries]
                    starts = start + np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                    start = int(starts[-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ident_of(k) for k, _ in entries], pa.int64()), pa.array(starts[:-1], pa.int64()), *(f(ids) for f in columns)], names=names
                    )

    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.count() // 8)
    return placed.select("path", "start").repartition(n, "path").mapInArrow(read, schema)
