"""Fill-in-the-middle transformation over the lines of a text.

The tokenizers library's ``Split`` pre-tokenizer, which needs no training, cuts
a text at isolated matches of a pattern and tells each piece's place in code
points.  The number of places is the number of units; two ranked places cut the
text into prefix, middle and suffix, by slices of the text itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
#: Code points that the pre-tokenizer gets at once; it holds some 30 bytes for
#: each, so a text of any length takes bounded memory beside itself.
PIECE = 1 << 18


@dataclass(frozen=True)
class FimParams:
    """``rate``: percent of documents that are transformed; ``spm``: percent of
    these with the suffix first.  ``markers`` stand before prefix, suffix and
    middle; a text with one of them stays plain."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")


def _line_splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(r"[^\n]*\n|[^\n]+"), "isolated")


def unit_ends(text: str, splitter=None, piece: int = PIECE) -> list[int]:
    """Where each line of ``text`` ends, in code points.

    Long texts are given to the pre-tokenizer in pieces; a unit that a piece
    cuts goes on with the first unit of the next.
    """
    splitter = splitter or _line_splitter()
    ends: list[int] = []
    for at in range(0, len(text), piece):
        if ends and text[at - 1] != "\n":
            ends.pop()
        ends += [at + end for _, (_, end) in splitter.pre_tokenize_str(text[at : at + piece])]
    return ends


def _draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit draws of a document."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transform(doc_id: int | None, text: str, params: FimParams, splitter) -> tuple[int, str, int | None, int | None, str]:
    """``(n, form, prefix_chars, middle_chars, output)`` of one document."""
    ends = unit_ends(text, splitter)
    h = _draws(params.seed, doc_id)
    n = len(ends)
    if not text or any(m in text for m in params.markers) or h[2] % 100 >= params.rate:
        return n, "plain", None, None, text
    first, last = ([0, *ends][k] for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    p, s, m = params.markers
    if h[3] % 100 < params.spm:
        return n, "spm", first, last - first, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", first, last - first, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, params: FimParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Transform every whole document; one row per input row (``SCHEMA``).

    Null text is empty, an empty text is ``plain`` with n 0; a null identifier
    draws as the word ``null`` and passes through.  Repeated rows draw the same
    and get the same answer each.  An empty table gives an empty one; other
    columns are ignored, whatever their names.  One text is held whole, with its
    line ends; the pre-tokenizer sees it in bounded pieces.
    """
    p = params or FimParams()
    if len(set(p.markers)) < 3 or not all(p.markers):
        raise ValueError("the three markers must differ and be non-empty")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _line_splitter()
        for batch in slices(batches, "text"):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = [transform(i, t or "", p, splitter) for i, t in zip(ids, texts, strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(work, SCHEMA)


def restored(output: Column, form: Column, params: FimParams | None = None) -> Column:
    """The exact text that ``output`` was made from.

    No marker occurs in a transformed text, so each marks one border.
    """
    markers = (params or FimParams()).markers
    parts = F.split(output, "|".join(f"\\Q{m}\\E" if "\\E" not in m else re.escape(m) for m in markers), -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
