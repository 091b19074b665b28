"""SentencePiece encoding and decoding by an Aho-Corasick automaton.

All pieces go into one automaton.  One pass over the text visits, at every
position, the pieces that end there (the automaton's output links, longest
first) and relaxes the best score of that position; the best path read backward
is the encoding.  Characters that no piece covers fall back to byte pieces.

Between two characters that are adjacent in no piece no piece can lie across,
so the best path of a text is the best paths of its segments end to end.  Each
distinct segment is solved once and remembered in two bounded generations; the
rest is gathers over Arrow buffers.

Literal U+2581 (the piece alphabet's space) is written as bytes, so decoding
gives back every text exactly.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import entry_bytes, slices, text_bytes

SPACE = "▁"
#: Stands for a literal U+2581 while a segment is solved; no UTF-8 text has it.
_LITERAL = "\udc81"
#: Fixed value: what an uncovered character costs below the least piece score.
UNKNOWN_PENALTY = 10.0


class PieceModel:
    """Vocabulary, automaton and segment memory of one model file.

    The memory has two generations of ``MOST`` bytes, entries counted with what
    Python keeps beside them; whole segments and the parts they are composed of
    count alike.  Segments of more than ``WIDEST`` characters are not kept: in
    texts without white space a segment is a whole text."""

    MOST = 32 << 20
    WIDEST = 256

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.automaton, scores, pairs = ahocorasick.Automaton(), [], set()
        self.byte = np.full(256, -1, dtype=np.int64)
        surface: list[bytes] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            surface.append(b"")
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                surface[-1] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                score = sp.get_score(i)
                scores.append(score)
                self.automaton.add_word(piece, (i, len(piece), score))
                pairs.update(zip(piece, piece[1:]))
                surface[-1] = piece.replace(SPACE, " ").encode()
        self.automaton.make_automaton()
        self.pairs = frozenset(pairs)
        self.single = frozenset(p for p in self.automaton.keys() if len(p) == 1)  # characters that are pieces
        self.unknown = min(scores) - UNKNOWN_PENALTY
        self.surface = b"".join(surface)
        self.surface_size = np.array([len(x) for x in surface], dtype=np.int64)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def solve(self, segment: str) -> list[int]:
        """The best path over ``segment`` (spaces already U+2581)."""
        n, best = len(segment), [0.0]
        best += [-1e300] * n
        took: list[tuple[int, int, float] | None] = [None] * (n + 1)  # (piece, size, score); None: one bare character
        if self.single.issuperset(segment):
            for end, hit in self.automaton.iter(segment):
                at = best[end + 1 - hit[1]] + hit[2]
                if at > best[end + 1]:
                    best[end + 1], took[end + 1] = at, hit
        else:
            ending: dict[int, list] = {}
            for end, hit in self.automaton.iter(segment):
                ending.setdefault(end + 1, []).append(hit)
            for to in range(1, n + 1):
                for hit in ending.get(to, ()):
                    at = best[to - hit[1]] + hit[2]
                    if at > best[to]:
                        best[to], took[to] = at, hit
                if segment[to - 1] not in self.single and best[to - 1] + self.unknown > best[to]:
                    best[to], took[to] = best[to - 1] + self.unknown, None
        path, at = [], n
        while at:
            hit = took[at]
            if hit:
                path.append(hit[0])
                at -= hit[1]
            else:
                raw = SPACE if segment[at - 1] == _LITERAL else segment[at - 1]
                path.extend(int(self.byte[b]) for b in reversed(raw.encode()))
                at -= 1
        return path[::-1]

    def segment_ids(self, segment: str) -> bytes:
        """Ids of a run of spaces and other characters, as 32-bit integers."""
        text = segment.replace(SPACE, _LITERAL).replace(" ", SPACE)
        got = self._recalled(text)
        if got is not None:
            return got
        pairs = self.pairs
        cuts = [k for k, pair in enumerate(zip(text, text[1:]), 1) if pair not in pairs]
        if not cuts:
            return self._kept(text, array("i", self.solve(text)).tobytes())
        parts = []
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            part = text[a:b]
            got = self._recalled(part)
            parts.append(self._kept(part, array("i", self.solve(part)).tobytes()) if got is None else got)
        return self._kept(text, b"".join(parts))

    def _recalled(self, text: str) -> bytes | None:
        got = self.new.get(text)
        if got is None and text in self.old:
            got = self._kept(text, self.old[text])
        return got

    def _kept(self, text: str, ids: bytes) -> bytes:
        """The one place at which memory grows, and is bounded."""
        if len(text) <= self.WIDEST:
            if self.held >= self.MOST:
                self.old, self.new, self.held = self.new, {}, 0
            self.new[text] = ids
            self.held += entry_bytes(text, ids)
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's ids begin.  A text that is
        not empty gets one space in front, as the model was trained."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        texts = pc.if_else(pc.greater(pc.binary_length(texts), 0), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())), texts)
        data, bounds = text_bytes(texts)
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        inner = bounds[:-1]
        begins[inner[inner < len(data)]] = True
        starts = np.flatnonzero(begins)
        offsets = np.append(starts, len(data)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        each = [self.segment_ids(x) for x in coded.dictionary.to_pylist()]
        sizes = np.array([len(x) for x in each], dtype=np.int64) // 4
        flat = np.frombuffer(b"".join(each), dtype="<i4")
        ids, ends = gather(flat, sizes, codes)
        return ids, np.concatenate(([0], ends))[np.searchsorted(starts, bounds)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts, end to end, and where each begins."""
        data, ends = gather(np.frombuffer(self.surface, dtype=np.uint8), self.surface_size, ids)
        begin = np.concatenate(([0], ends))[bounds]
        full = np.diff(begin) > 0
        first = begin[:-1][full]
        keep = np.ones(len(data), dtype=bool)
        keep[first[data[first] == 32]] = False
        dropped = np.zeros(len(begin), dtype=np.int64)
        lead = np.zeros(len(full), dtype=np.int64)
        lead[full] = ~keep[first]
        np.cumsum(lead, out=dropped[1:])
        return data[keep], begin - dropped


def gather(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that ``codes`` name, end to end, and their ends."""
    n = sizes[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - n), n) + np.arange(total)], ends


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"cast(`{text_col}` as string) AS text")


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` of every whole text.  ``model`` is the path of
    a SentencePiece file.

    Null or empty text: no ids.  A null identifier passes through, repeated
    rows are encoded each, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in slices(batches, "text"):
            ids, bounds = pieces.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), lists], names=["doc_id", "n_tokens", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from id lists; a null list gives an empty text, null
    entries in a list are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = [np.array([i for i in x or [] if i is not None], dtype=np.int64) for x in part.column("ids").to_pylist()]
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
                data, begin = pieces.decode(np.concatenate(lists), bounds)
                text = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(begin), pa.py_buffer(data)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), text], names=["doc_id", "text"])

    return encoded.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"cast(`{ids_col}` as array<int>) AS ids").mapInArrow(run, "doc_id long, text string")


def encoding_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text: ``doc_id, n_tokens, ids_crc32``
    (of the ids as little-endian unsigned 32-bit integers) and ``round_trip``,
    whether decoding gave the text back byte for byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            ids, bounds = pieces.encode(texts)
            data, begin = pieces.decode(ids.astype(np.int64), bounds)
            given, given_at = text_bytes(texts)
            same = np.diff(begin) == np.diff(given_at)
            if same.all():
                wrong = np.concatenate(([0], np.cumsum(given != data)))
                same &= wrong[given_at[1:]] == wrong[given_at[:-1]]
            else:
                same &= [data[a:b].tobytes() == given[c:d].tobytes() for a, b, c, d in zip(begin[:-1], begin[1:], given_at[:-1], given_at[1:])]
            raw = memoryview(np.ascontiguousarray(ids, dtype="<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"]
            )

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
