"""Repetition rules from a suffix array over the words of each text.

The suffix array is built by prefix doubling, for a few megabytes of texts at
once: positions get the rank of the 1, 2, 4, 8 ... words that follow, and only
those whose rank is shared within their own text are ranked further.  The
longest common prefix of neighbouring suffixes follows from the rank tables,
highest doubling first.  The intervals it spans are the maximal repeated
substrings; their union gives the share of the text that repeats, and the
largest value the longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, slices, text_bytes

#: Fixed values of the quality contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class RepetitionLimits:
    """``min_words``: fewer words fail.  ``max_window_percent``: most words, in
    percent, that may lie in repeated five-word windows.  ``min_repeat``: words
    from which a repeated substring counts.  ``max_covered_percent``: most
    words that such repeats may cover together.  ``max_longest``: most words in
    one repeat."""

    min_words: int = 10
    max_window_percent: int = 20
    min_repeat: int = 10
    max_covered_percent: int = 20
    max_longest: int = 50


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_words long, longest_repeat long"
)


def repeat_lengths(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word position, the length of the longest word sequence that
    starts there and also starts elsewhere in the same text.  Lengths below four
    words may be given as less."""
    n = len(codes)
    out = np.zeros(n, dtype=np.int64)
    if n == 0:
        return out
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
    end = np.repeat(first[1:], np.diff(first))
    key = doc * (int(codes.max()) + 1) + codes
    at, base, span = np.arange(n), np.zeros(n, dtype=np.int64), 1
    ranks: list[np.ndarray] = []
    sites = at[:0]
    while True:
        # refine the groups that are left; a rank is its group's place in the array
        order = np.argsort(key)
        key, at, base = key[order], at[order], base[order]
        place = np.arange(len(at))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        old = np.concatenate(([True], base[1:] != base[:-1]))
        fresh = base + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(old, place, 0))
        rank = ranks[-1].copy() if ranks else np.zeros(n, dtype=np.int64)
        rank[at] = fresh
        ranks.append(rank)
        shared = ~(new & np.concatenate((new[1:], [True])))
        at = at[shared]
        if len(ranks) == 3:
            sites = at
        if not len(at):
            break
        base = rank[at]
        ahead = at + span
        inside = ahead < end[at]
        follow = np.zeros(len(at), dtype=np.int64)
        follow[inside] = rank[ahead[inside]] + 1
        key = base * (n + 1) + follow
        span *= 2
    if not len(sites):
        return out
    top = len(ranks) - 1
    array = sites[np.argsort(ranks[top][sites])]
    left, right = array[:-1], array[1:]
    common = np.zeros(len(left), dtype=np.int64)
    for k in range(top, -1, -1):
        ok = (left + common < end[left]) & (right + common < end[right])
        pair = np.flatnonzero(ok)
        a, b = left[pair] + common[pair], right[pair] + common[pair]
        hit = pair[ranks[k][a] == ranks[k][b]]
        common[hit] += 1 << k
    np.maximum.at(out, left, common)
    np.maximum.at(out, right, common)
    return out


def _covered(lengths: np.ndarray, least: int, first: np.ndarray) -> np.ndarray:
    """Words of each text in the union of the repeats of ``least`` words or more."""
    n = len(lengths)
    start = np.flatnonzero(lengths >= least)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + lengths[start], -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return inside[first[1:]] - inside[first[:-1]]


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _dup_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line of the text."""
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The repetition figures of each text."""
    words = Words(texts)
    first = words.first
    codes, _ = words.coded()
    lengths = repeat_lengths(codes.astype(np.int64), first)
    data, bounds = text_bytes(texts)
    begins_char = (data & 0xC0) != 0x80
    symbol = np.zeros(256, dtype=bool)
    symbol[np.frombuffer(SYMBOLS.encode(), dtype=np.uint8)] = True
    longest = np.zeros(len(first) - 1, dtype=np.int64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        longest[full] = np.maximum.reduceat(lengths, first[:-1][full])
    return {
        "n_words": np.diff(first),
        "word_chars": _per_text(begins_char & ~words.white, bounds),
        "n_symbols": _per_text(symbol[data], bounds),
        "n_dup_lines": np.array([_dup_lines(x) for x in texts.to_pylist()], dtype=np.int64),
        "n_repeat_words": _covered(lengths, WINDOW, first),
        "longest_repeat": longest,
        "lengths": lengths,
        "first": first,
    }


def repetition_rules(docs: DataFrame, limits: RepetitionLimits | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judge each document by how much of it repeats.

    Returns one row per input row with the columns of ``SCHEMA``.  A document
    is kept unless it fails the base rule, repeats of at least ``min_repeat``
    words cover more than ``max_covered_percent`` of its words, or one repeat
    is longer than ``max_longest`` words.

    Null or empty text: all counts 0, ``base_failed`` true, not kept.  A null
    identifier passes through.  Repeated rows get the same answer each.  Other
    columns are ignored.  Texts are measured whole; a very long one is measured
    alone, in memory proportional to its length.
    """
    limits = limits or RepetitionLimits()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            m = measure(batch.column("text"))
            n = m["n_words"]
            covered = _covered(m["lengths"], limits.min_repeat, m["first"])
            failed = (n < limits.min_words) | (100 * m["n_repeat_words"] > limits.max_window_percent * n)
            kept = ~failed & (100 * covered <= limits.max_covered_percent * n) & (m["longest_repeat"] <= limits.max_longest)
            counts = [pa.array(m[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(failed), pa.array(kept), pa.array(covered, pa.int64()), pa.array(m["longest_repeat"], pa.int64())],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat"],
            )

    rows = docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"cast(`{text_col}` as string) AS text")
    return rows.mapInArrow(judge, SCHEMA)
