"""Language identification: scripts narrow the candidates, Viterbi labels spans.

Learning takes a bounded, documented sample of labelled documents and counts
hashed character n-grams of their words per language.  A word's score for a
language is the sum of its n-grams' log probabilities; languages that are not
written in the word's script are out.  Over the words of a text a Viterbi pass
with a penalty for each switch of language finds the best labelling, so
mixed-language texts come out as spans.

Whether a text is in a learned language at all is another question: letters of
scripts that no language was learned from belong to none, and the winning
label's words must be about as likely, per letter, as labelled documents are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, slices

#: First code point of each script range, and its name.
SCRIPT_RANGES = [
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "none"),
    (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Han"), (0xFB50, "Arabic"), (0xFE70, "Arabic"), (0xFF21, "Latin"),
]
NGRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: Type of a language's number.
LABEL = np.int32
_STARTS = np.array([a for a, _ in SCRIPT_RANGES])
SCRIPTS = sorted({b for _, b in SCRIPT_RANGES})
_SCRIPT_OF = np.array([SCRIPTS.index("none")] + [SCRIPTS.index(b) for _, b in SCRIPT_RANGES])


@dataclass(frozen=True)
class LangIdParams:
    """``sample``: most labelled documents to learn from, those with the least
    hashes of their identifiers.  ``switch``: cost of a change of language
    between two words, in nats.  ``smoothing``: added to every n-gram count."""

    sample: int = 6000
    switch: float = 12.0
    smoothing: float = 0.5


@dataclass
class LangModel:
    """``scores[n-gram bucket, language]`` and ``scripts[script, language]``."""

    langs: list[str]
    scores: np.ndarray
    scripts: np.ndarray
    params: LangIdParams = field(default_factory=LangIdParams)
    #: By language: the least log-probability a letter of long texts, and the
    #: variance a letter by which short ones may miss it.
    floors: np.ndarray | None = None
    noise: np.ndarray | None = None


def _words_of(texts) -> list[str]:
    """All words of ``texts``, as scoring takes them."""
    return Words(pa.array(texts, pa.string())).array().to_pylist()


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased letters of each word between two border
    marks, the word of each code point, and whether it is a letter."""
    clean = ["".join(c for c in w.lower() if c.isalpha()) if not w.isalpha() else w.lower() for w in words]
    text = "".join(f"\x02{w}\x02" for w in clean)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in clean])
    return points, owner, points != 2


def _grams(points: np.ndarray, owner: np.ndarray, letter: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash buckets of the n-grams of each word, and the word of each."""
    key = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        key = key[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :].astype(np.uint64)
        if n in NGRAMS:
            same = owner[: len(key)] == owner[n - 1 :]
            same &= letter[: len(key)] | (n > 1)
            yield (mix(key[same], n) % np.uint64(BUCKETS)).astype(np.int64), owner[: len(key)][same]


def _fits(words: list[str], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log-probability of each word by language; its code points by word."""
    points, owner, letter = _letters(words)
    out = np.zeros((len(words), scores.shape[1]), dtype=np.float64)
    for bucket, at in _grams(points, owner, letter):
        for k in range(scores.shape[1]):
            out[:, k] += np.bincount(at, weights=scores[bucket, k], minlength=len(words))
    return out, points, owner, letter


def word_scores(words: list[str], model: LangModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log-probability of each word by language, less the best one's; its number
    of letters; the log-probabilities as they are; whether a language was
    learned in its script."""
    fit, points, owner, letter = _fits(words, model.scores)
    out = fit.copy()
    script = _SCRIPT_OF[np.searchsorted(_STARTS, points, side="right")]
    seen = np.zeros((len(words), len(SCRIPTS)))
    np.add.at(seen, (owner[letter], script[letter]), 1)
    main = seen.argmax(axis=1)
    size = seen.sum(axis=1)
    allowed = model.scripts[main]
    known = allowed.any(axis=1)
    allowed[~known] = True
    out[~allowed] = -1e3
    out[size == 0] = 0
    return out - out.max(axis=1, keepdims=True), size.astype(np.int64), fit, known


def train(docs: DataFrame, params: LangIdParams | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", floors: bool = False) -> LangModel:
    """Learn from the labelled ``docs``; rows with a null text or language are
    left out.  The sample's n-grams are counted on executors and only the
    counts (languages x buckets) reach the driver.  Without a labelled row the
    model has no language, and every text is ``und``.

    ``floors``: also learn how likely documents of each language are.  Each half
    of the sample is scored by the counts of the other, so that no document is
    judged by itself; see ``_floors``."""
    p = params or LangIdParams()
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("half")), F.lit(2)).cast("int").alias("half"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    # identifiers first, so that texts beyond the sample are never moved
    limit = labelled.select(F.xxhash64("id").alias("h")).orderBy("h").limit(p.sample).agg(F.max("h")).first()[0]
    if limit is None:
        return LangModel([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS), 0), dtype=bool), p)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple[str, int], np.ndarray] = {}
        for frame in batches:
            for key, group in frame.groupby(["lang", "half"]):
                row = totals.setdefault(key, np.zeros(BUCKETS + len(SCRIPTS)))
                for at in range(0, len(group), 20):
                    points, owner, letter = _letters(_words_of(group["text"].iloc[at : at + 20]))
                    for bucket, _ in _grams(points, owner, letter):
                        row[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    row[BUCKETS:] += np.bincount(_SCRIPT_OF[np.searchsorted(_STARTS, points[letter], side="right")], minlength=len(SCRIPTS))
        for (lang, half), row in totals.items():
            at = np.flatnonzero(row)
            yield pd.DataFrame({"lang": lang, "half": half, "bucket": at, "n": row[at]})

    sample = labelled.where(F.xxhash64("id") <= limit).select("lang", "half", "text")
    counted = sample.mapInPandas(count, "lang string, half int, bucket long, n double")
    table = counted.groupBy("lang", "half", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    halves = np.zeros((2, BUCKETS + len(SCRIPTS), len(langs)))
    halves[table["half"], table["bucket"], [langs.index(x) for x in table["lang"]]] = table["n"]

    def logs(n: np.ndarray) -> np.ndarray:
        counts = n[:BUCKETS] + p.smoothing
        return np.log(counts / counts.sum(axis=0))

    raw = halves.sum(axis=0)
    scripts = raw[BUCKETS:] > 0.01 * raw[BUCKETS:].sum(axis=0, keepdims=True)
    model = LangModel(langs, logs(raw), scripts, p)
    if floors:
        model.floors, model.noise = _floors(sample, langs, [logs(halves[1]), logs(halves[0])])
    return model


#: Letters of a document that counts for floors, documents a
#: language needs for one, deviations of chance that a text may lie below it.
FLOOR_LETTERS, FLOOR_DOCS, FLOOR_SDS = 200, 40, 3.0


def _floors(sample: DataFrame, langs: list[str], others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Floor and noise of each language from the labelled ``sample``, whose half
    ``k`` is scored by ``others[k]``.

    The floor lies twice as far below the median document as the lowest
    hundredth does, so that a few documents with a wrong label do not move it.
    The noise is the variance of a word's log-probability, by letter.  A
    language with fewer than 40 documents of 200 letters has no floor: it can
    not be told what is unlikely in it.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for lang, half, text in zip(frame["lang"], frame["half"], frame["text"]):
                fit, _, owner, letter = _fits(_words_of([text]), others[half][:, [langs.index(lang)]])
                size = np.bincount(owner[letter], minlength=len(fit))
                n = int(size.sum())
                if n >= FLOOR_LETTERS:
                    mean = fit[size > 0, 0].sum() / n
                    out.append((lang, mean, ((fit[:, 0] - mean * size)[size > 0] ** 2).sum() / n))
            yield pd.DataFrame(out, columns=["lang", "mean", "noise"])

    docs = sample.mapInPandas(measure, "lang string, mean double, noise double").toPandas()
    floors, noise = np.full(len(langs), -np.inf), np.zeros(len(langs))
    for lang, group in docs.groupby("lang"):
        if len(group) >= FLOOR_DOCS:
            middle, low = group["mean"].quantile(0.5), group["mean"].quantile(0.01)
            floors[langs.index(lang)], noise[langs.index(lang)] = middle - 2 * (middle - low), group["noise"].median()
    return floors, noise


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best language of every word.  ``first`` says where each text begins;
    all texts of a batch advance one word at a time together."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    starts, lengths = first[:-1][order], n[order]
    back = np.full(scores.shape, -1, dtype=LABEL)
    best = np.zeros((len(order), scores.shape[1]))
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")
    for t in range(steps):
        k = alive[t]
        now, at = best[:k], starts[:k] + t
        if t:
            top = now.argmax(axis=1)
            level = now[np.arange(k), top][:, None] - switch
            turn = now < level
            now = np.where(turn, level, now)
            back[at] = np.where(turn, top[:, None], np.arange(scores.shape[1])[None, :])
        best[:k] = now + scores[at]
    label = np.zeros(len(scores), dtype=LABEL)
    state = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        at = starts[:k] + t
        label[at] = state[:k]
        if t:
            state[:k] = back[at, state[:k]]
    return label


def label_batch(texts: pa.Array, model: LangModel) -> dict[str, np.ndarray]:
    """Language and score of each text, and the label and letters of each word."""
    words = Words(texts)
    codes, distinct = words.coded()
    n_lang = len(model.langs)
    if len(codes) == 0 or n_lang == 0:
        none, codes = np.full(len(texts), -1), np.zeros(0, dtype=np.int64)
        first = np.zeros(len(texts) + 1, dtype=np.int64)
        return {"lang": none, "score": np.zeros(len(texts)), "label": codes.astype(LABEL), "size": codes, "first": first}
    table, size, fit, known = word_scores(distinct.to_pylist(), model)
    label = viterbi(table[codes], words.first, model.params.switch)
    weight = size[codes]
    doc = words.doc_of()
    mass = np.bincount(doc * n_lang + label, weights=weight, minlength=len(texts) * n_lang).reshape(-1, n_lang)
    total = mass.sum(axis=1)
    return {
        "lang": np.where(total > 0, mass.argmax(axis=1), -1),
        "score": np.where(total > 0, mass.max(axis=1) / np.maximum(total, 1), 0.0),
        "label": label, "size": weight, "first": words.first, "words": words,
        "fit": fit[codes, label], "known": known[codes],
    }


def learned(texts: pa.Array, model: LangModel, min_score: float) -> np.ndarray:
    """Whether each text is written in a learned language: one label has
    ``min_score`` of all letters by words of learned scripts, and these words
    are, per letter, as likely as the label's floor asks for."""
    got, n_lang = label_batch(texts, model), len(model.langs)
    if "words" not in got:
        return np.zeros(len(texts), dtype=bool)
    at = got["words"].doc_of() * n_lang + got["label"]
    by_label = lambda x: np.bincount(at, weights=x, minlength=len(texts) * n_lang).reshape(-1, n_lang)
    mine = got["size"] * got["known"]
    mass, total = by_label(mine), by_label(got["size"]).sum(axis=1)
    best = (np.arange(len(texts)), mass.argmax(axis=1))
    n = np.maximum(mass[best], 1)
    good = (mass[best] > 0) & (mass[best] >= min_score * total)
    if model.floors is not None:
        fit = by_label(np.where(mine > 0, got["fit"], 0.0))[best] / n
        good &= fit >= model.floors[best[1]] - FLOOR_SDS * np.sqrt(model.noise[best[1]] / n)
    return good


def _named(got: dict[str, np.ndarray], langs: list[str]) -> pa.Array:
    return pa.array(np.array([*langs, "und"], dtype=object)[got["lang"]], pa.string())


def _span_starts(got: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each span of one language, and the span's text."""
    label, first = got["label"], got["first"]
    begin = np.concatenate(([True], label[1:] != label[:-1]))[: len(label)]
    begin[first[:-1][np.diff(first) > 0]] = True
    at = np.flatnonzero(begin)
    return at, np.searchsorted(first, at, side="right") - 1


def identify(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, n_spans, switches`` for each row: the language
    with the most letters, its share of them, the spans of one language, and
    the words (from 0) at which the language switches.

    Null, empty or letterless text: ``und`` with score 0; without words, or a
    learned language, no spans.  Ties go to the language that sorts first.  A
    null identifier passes through, repeated rows get the same answer each,
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = label_batch(batch.column("text"), model)
            at, doc = _span_starts(got)
            n = np.bincount(doc, minlength=batch.num_rows)
            place = at - got["first"][doc]
            bounds = np.concatenate(([0], np.cumsum(np.maximum(n - 1, 0))))
            switches = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(place[place > 0], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _named(got, model.langs), pa.array(got["score"], pa.float64()), pa.array(n, pa.int64()), switches], names=["doc_id", "lang_pred", "score", "n_spans", "switches"]
            )

    rows = docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"cast(`{text_col}` as string) AS text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, n_spans long, switches array<long>")


def spans(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of one language: ``doc_id, first_word, n_words, lang`` in reading
    order; words without a letter go with the span around them.  Null and empty
    texts have none; repeated rows have theirs each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = label_batch(batch.column("text"), model)
            if not len(got["label"]):
                continue
            at, doc = _span_starts(got)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(at - got["first"][doc], pa.int64()), pa.array(np.diff(np.append(at, len(got["label"]))), pa.int64()),
                 pa.array(np.array(model.langs, dtype=object)[got["label"][at]], pa.string())],
                names=["doc_id", "first_word", "n_words", "lang"],
            )

    rows = docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"cast(`{text_col}` as string) AS text")
    return rows.mapInArrow(run, "doc_id long, first_word long, n_words long, lang string")


def accepted(docs: DataFrame, model: LangModel, min_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """``docs`` whose text has a language with at least ``min_score`` of its
    letters, where letters of unlearned scripts have none; if ``model`` has
    floors, that language must also be as likely as they ask for.  Rows pass
    through with all their columns, without a shuffle.

    Null, empty and letterless texts go; a null identifier is nothing special;
    repeated rows stay or go together; an empty table gives an empty result."""
    # Spark hands columns to Python by unquoted name: those with dots get others on the way
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield batch.filter(pa.array(learned(batch.column(text), model, min_score)))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
