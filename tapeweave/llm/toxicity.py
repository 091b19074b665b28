"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows.

The lexicon is learned from labelled documents: words, and stems of words, that
toxic documents hold significantly more often.  It is kept as a trie.  A word
is read once by the intersection of the trie with Levenshtein automata (edits
are insertions, deletions, substitutions and swaps; how many depends on the
length of the lexicon's word), determinised as it is needed, so misspelled
terms cost one table look-up per character.  A window of words around each hit
tells quotation from abuse: quotation marks and reporting words lower a hit's
weight, address to a person raises it.  A logistic regression over a few sums
gives the score.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, slices

#: Digits and marks that stand for letters.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
#: Marks that a word sheds at either end.
MARKS = ".,;:!?*$%&#|<>()[]{}'\"`~^_+=/\\-“”„«»‘’…–—¡¿"
#: Quotation marks, those of them that are apostrophes too; words
#: of reporting; words of address.
QUOTES = "\"“”„«»‘’"
SINGLE = "‘’"
REPORTING = frozenset("said says quoted quote called wrote word term reported dijo dit disait sagte genannt zitiert mot wort palabra".split())
ADDRESS = frozenset("you your you're ur u du dich dein tu toi vous ton tú eres".split())


@dataclass(frozen=True)
class ToxicityParams:
    """``sample``: most labelled documents to learn from, those with the least
    hashes of their identifiers.  ``min_z``: standard errors by which a term's
    log odds must exceed 0; from ``fuzzy_z`` on its misspellings count too.
    ``window``: words on each side of a hit.
    ``stems``: lengths of stems.  ``min_family``: different words
    that a stem must begin.  ``max_terms``: most terms, by significance."""

    sample: int = 12_000
    min_z: float = 3.6
    fuzzy_z: float = 4.2
    window: int = 6
    stems: tuple[int, ...] = (4, 5, 6)
    min_family: int = 4
    max_terms: int = 4000
    ridge: float = 1.0


def plain(words: pa.Array) -> list[str]:
    """Words in lower case, without marks at either end."""
    return pc.utf8_trim(pc.utf8_lower(words), characters=MARKS).to_pylist()


def inside_quotation(words: list[str]) -> bool:
    """Whether a quotation is open after ``words``: an odd number of double
    marks, or a single mark that opened and none that closed.  A single mark
    between two letters is an apostrophe, and one at a word's end closes only."""
    double, single = 0, False
    for word in words:
        for k, c in enumerate(word):
            if c in SINGLE:
                if not (0 < k < len(word) - 1 and word[k - 1].isalpha() and word[k + 1].isalpha()):
                    single = c == "‘"
            elif c in QUOTES:
                double += 1
    return double % 2 == 1 or single


def edits(term: str) -> int:
    """Edits allowed for a term: 0 below five letters, 1, 2 from nine on."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """The trie of ``words`` and ``stems`` with Levenshtein automata on it."""

    MOST_STATES = 50_000

    def __init__(self, words: dict[str, float], stems: dict[str, float], exact: frozenset[str] = frozenset()):
        """``exact``: words whose misspellings don't count."""
        self.allowed = {w: 0 if w in exact else edits(w) for w in words}
        self.next: list[dict[str, int]] = [{}]
        self.word_at: list[str | None] = [None]
        self.stem_at: list[str | None] = [None]
        self.reach = [0]  # most edits that any term below a node allows
        for term in [*words, *stems]:
            node, most = 0, self.allowed.get(term, 0)
            self.reach[0] = max(self.reach[0], most)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.word_at.append(None)
                    self.stem_at.append(None)
                    self.reach.append(0)
                node = self.next[node][c]
                self.reach[node] = max(self.reach[node], most)
            if term in words:
                self.word_at[node] = term
            if term in stems:
                self.stem_at[node] = term
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.accepts: list[tuple[int, str] | None] = []
        self.stem_hit: list[str | None] = []
        self._state(self._closed({(0, 0, "")}))

    def _closed(self, positions: set) -> frozenset:
        """Adds what lies one missing letter further, and drops hopeless positions."""
        todo, best = list(positions), set(positions)
        while todo:
            node, used, wait = todo.pop()
            if not wait:
                for child in self.next[node].values():
                    new = (child, used + 1, "")
                    if used + 1 <= self.reach[child] and new not in best:
                        best.add(new)
                        todo.append(new)
        return frozenset(best)

    def _state(self, positions: frozenset) -> int:
        if positions not in self.states:
            self.states[positions] = len(self.sets)
            self.sets.append(positions)
            self.moves.append({})
            ends = [(used, self.word_at[n]) for n, used, wait in positions if not wait and self.word_at[n] and used <= self.allowed[self.word_at[n]]]
            self.accepts.append(min(ends) if ends else None)
            stems = [self.stem_at[n] for n, used, wait in positions if used == 0 and not wait and self.stem_at[n]]
            self.stem_hit.append(stems[0] if stems else None)
        return self.states[positions]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, used, wait in self.sets[state]:
            if wait:
                if wait == c:
                    out.add((node, used, ""))
                continue
            for letter, child in self.next[node].items():
                if letter == c:
                    out.add((child, used, ""))
                elif used + 1 <= self.reach[child]:
                    out.add((child, used + 1, ""))
                    after = self.next[child].get(c)  # a swap: this letter first, then the other
                    if after is not None and used + 1 <= self.reach[after]:
                        out.add((after, used + 1, letter))
            if used + 1 <= self.reach[node]:
                out.add((node, used + 1, ""))
        to = self._state(self._closed(out)) if out else -1
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[str, int, str] | None:
        """``(kind, edits, term)`` of the best term for ``word``: ``word`` or
        ``stem``; None if there is none."""
        state, stem, moves = 0, None, self.moves
        for c in word:
            to = moves[state].get(c)
            if to is None:
                if len(self.sets) > self.MOST_STATES:  # bounded memory
                    self._reset()
                    return self.match(word)
                to = self._move(state, c)
            if to < 0:
                state = -1
                break
            state = to
            stem = stem or self.stem_hit[state]
        found = self.accepts[state] if state >= 0 else None
        if found and found[0] == 0 or found and not stem:
            return ("word", *found)
        return ("stem", 0, stem) if stem else None


@dataclass
class ToxicityModel:
    """Lexicon, which of its words match exactly only, misspellings known to be
    innocent, and regression weights."""

    words: dict[str, float]
    stems: dict[str, float]
    exact: frozenset[str] = frozenset()
    innocent: frozenset[str] = frozenset()
    weights: np.ndarray | None = None
    params: ToxicityParams = field(default_factory=ToxicityParams)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


N_FEATURES = 8


class Scorer:
    """Features of texts under a model."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.automaton = LexiconAutomaton(model.words, model.stems, model.exact)

    def lookup(self, distinct: pa.Array) -> dict[int, tuple[str, int, str, str]]:
        """``(kind, edits, term, form)`` by place, of the words with a match."""
        match, innocent = self.automaton.match, self.model.innocent
        forms = plain(distinct)
        found = {i: (*got, f) for i, f in enumerate(forms) if (got := match(f)) and not (got[1] and f in innocent)}
        odd = pc.match_substring_regex(distinct, r"[A-Za-z].*[013457@$!]|[013457@$!].*[A-Za-z]").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd).tolist():
            got = match(forms[i].translate(LOOKALIKES))
            if got and got[0] == "word" and (i not in found or found[i][1] > max(1, got[1])) and forms[i] not in innocent:
                found[i] = ("word", max(1, got[1]), got[2], forms[i])
        return found

    def hits(self, texts: pa.Array) -> tuple[Words, np.ndarray, list]:
        """Word positions with a match, and the matches."""
        words = Words(texts)
        codes, distinct = words.coded()
        found = self.lookup(distinct)
        is_hit = np.zeros(len(distinct), dtype=bool)
        is_hit[list(found)] = True
        at = np.flatnonzero(is_hit[codes]) if len(codes) else np.zeros(0, dtype=np.int64)
        self._distinct, self._codes = distinct, codes
        return words, at, [found[c] for c in codes[at].tolist()]

    def context(self, at: int, begin: int, end: int) -> tuple[float, bool]:
        """Weight factor of a hit from the words around it, and whether it
        stands in a quotation."""
        w = self.model.params.window
        since = max(begin, at - w)
        near = self._distinct.take(pa.array(self._codes[since : min(end, at + w + 1)]))
        raw = near.to_pylist()
        own, before = raw[at - since], raw[: at - since]
        opening = own[: len(own) - len(own.lstrip(MARKS))]
        quoted = inside_quotation([*before, opening])
        forms = set(plain(near))
        factor = (0.4 if quoted else 1.0) * (0.6 if forms & REPORTING else 1.0) * (1.2 if forms & ADDRESS else 1.0)
        return factor, quoted

    def features(self, texts: pa.Array) -> np.ndarray:
        words, at, found = self.hits(texts)
        out = np.zeros((len(texts), N_FEATURES))
        size = np.diff(words.first)
        doc_of = np.searchsorted(words.first, at, side="right") - 1
        terms: dict[int, set[str]] = {}
        m = self.model
        for pos, doc, (kind, used, term, _) in zip(at.tolist(), doc_of.tolist(), found):
            factor, quoted = self.context(pos, int(words.first[doc]), int(words.first[doc + 1]))
            weight = (m.words if kind == "word" else m.stems)[term] * factor / (1 + used)
            row = out[doc]
            row[0 if kind == "word" and used == 0 else 1 if kind == "word" else 2] += factor
            row[3] += weight
            row[4] = max(row[4], weight)
            row[5] += quoted
            terms.setdefault(doc, set()).add(term)
        for doc, own in terms.items():
            out[doc, 6] = len(own)
        out[:, 7] = out[:, 3] / np.maximum(size, 1) * 100
        out[:, (0, 1, 2, 3, 5, 6, 7)] = np.log1p(out[:, (0, 1, 2, 3, 5, 6, 7)])
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.model.weights[1:] + self.model.weights[0], -30, 30)))


_scorers: dict[str, Scorer] = {}


def scorer_of(model: ToxicityModel) -> Scorer:
    """The worker's scorer for ``model``, kept from task to task."""
    key = f"{model.name}/{model.weights is not None}/{len(model.innocent)}"
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _terms(forms: list[str], stems: tuple[int, ...]) -> set[tuple[str, bool, str]]:
    """Terms of a text's words, each once, with the first context it stands in:
    the word before, and for a stem also its own word."""
    out: dict[tuple[str, bool], str] = {}
    for before, f in zip(["", *forms], forms):
        if f and (f, False) not in out:
            out[f, False] = before
            for k in stems:
                if len(f) > k:
                    out.setdefault((f[:k], True), f"{before} {f}")
    return {(*term, context) for term, context in out.items()}


def _forms(texts: pa.Array) -> Iterator[list[str]]:
    """Each text's words, as scoring takes them, in plain form."""
    words = Words(texts)
    forms = plain(words.array())
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        yield forms[a:b]


def _counts(rows: DataFrame, stems: tuple[int, ...], only: frozenset | None) -> DataFrame:
    """``term, stem, n, effective, family``: documents that hold each term (of
    ``only``), how many they are worth, and the different words of a stem.

    Copies and near copies of one document repeat its words in the same
    contexts.  ``n`` squared over the sum of the squared counts of the contexts
    is about 1 for them, and near ``n`` for a word used freely.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), 500):
                own: Counter = Counter()
                for forms in _forms(pa.array(frame["text"].iloc[at : at + 500], pa.string())):
                    own.update(t for t in _terms(forms, stems) if only is None or t[:2] in only)
                if own:
                    yield pd.DataFrame({"term": [t for t, _, _ in own], "stem": [s for _, s, _ in own], "context": [c for _, _, c in own], "n": list(own.values())})

    n = F.col("n").cast("double")
    found = rows.select("text").mapInPandas(count, "term string, stem boolean, context string, n long").groupBy("term", "stem", "context").agg(F.sum("n").alias("n"))
    return found.groupBy("term", "stem").agg(F.sum("n").alias("n"), (F.sum(n) * F.sum(n) / F.sum(n * n)).alias("effective"), F.count_distinct(F.substring_index("context", " ", -1)).alias("family"))


def _lexicon(rows: DataFrame, n_toxic: int, n_clean: int, p: ToxicityParams) -> ToxicityModel:
    """Significant words and stems.  Terms are proposed by the toxic documents
    of the sample, and only those are counted in the clean ones."""
    bad = _counts(rows.where("toxic = 1"), p.stems, None).where(f"effective >= 3 AND (NOT stem OR family >= {p.min_family})").select("term", "stem", F.col("effective").alias("bad")).toPandas()
    only = frozenset(zip(bad["term"], bad["stem"]))
    good = _counts(rows.where("toxic = 0"), p.stems, only).select("term", "stem", F.col("n").alias("good")).toPandas()
    table = bad.merge(good, on=["term", "stem"], how="left").fillna({"good": 0})
    table["odds"] = np.log((table["bad"] + 0.5) / (n_toxic + 1)) - np.log((table["good"] + 0.5) / (n_clean + 1))
    table["z"] = table["odds"] / np.sqrt(1 / (table["bad"] + 0.5) + 1 / (table["good"] + 0.5))
    table = table[(table["z"] > p.min_z) & (table["odds"] > 1.5)].sort_values(["z", "term"], ascending=[False, True]).head(p.max_terms)
    words, stems = (dict(zip(t["term"], t["odds"])) for t in (table[~table["stem"]], table[table["stem"]]))
    # the shortest stem stands for its words and for longer stems
    stems = {k: v for k, v in stems.items() if not any(k != o and k.startswith(o) for o in stems)}
    words = {w: v for w, v in words.items() if not any(w.startswith(k) for k in stems)}
    sure = set(table[~table["stem"] & (table["z"] >= p.fuzzy_z)]["term"])
    return ToxicityModel(words, stems, frozenset(words) - sure, params=p)


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from ``labels`` (identifier, 0 or 1; null labels are left out) of
    at most ``params.sample`` rows.  Counting runs on executors; the driver
    gets the significant terms and the sample's features.  Without examples of
    both labels there is nothing to tell apart, and every text scores 0.0025.
    Labels that disagree (of one identifier, or of equal texts) count as toxic."""
    p = params or ToxicityParams()
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.groupBy("__id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(p.sample)  # at most `sample` rows: a bounded broadcast
    found = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(chosen), docs[id_col] == F.col("__id")).select(F.col(text_col).cast("string").alias("text"), "toxic")
    rows = cut(found.groupBy("text").agg(F.max("toxic").alias("toxic")))  # the documents are read for it once
    totals = dict(rows.groupBy("toxic").count().collect())
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel({}, {}, weights=np.array([-6.0] + [0.0] * N_FEATURES), params=p)
    model = _lexicon(rows, n_toxic, n_clean, p)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_of(model)
        for frame in batches:
            for at in range(0, len(frame), 500):
                part = frame.iloc[at : at + 500]
                texts = pa.array(part["text"], pa.string())
                words, pos, found = scorer.hits(texts)
                doc = np.searchsorted(words.first, pos, side="right") - 1
                forms: list[list[str]] = [[] for _ in range(len(part))]
                for m, k in zip(found, doc.tolist()):
                    if m[1]:
                        forms[k].append(m[3])
                yield pd.DataFrame({"toxic": part["toxic"].to_numpy(), "forms": [sorted(set(f)) for f in forms], "x": list(scorer.features(texts))})

    seen = rows.mapInPandas(measure, "toxic int, forms array<string>, x array<double>").toPandas()
    bad, good = Counter(), Counter()
    for toxic, forms in zip(seen["toxic"], seen["forms"]):
        (bad if toxic else good).update(forms)
    share = n_toxic / (n_toxic + n_clean)
    model.innocent = frozenset(f for f in good if good[f] * share > bad[f])
    if model.innocent:
        seen = rows.mapInPandas(measure, "toxic int, forms array<string>, x array<double>").toPandas()
    x, y = np.stack(seen["x"]), seen["toxic"].to_numpy()
    order = np.lexsort((y, *x.T))  # sums come out the same whatever order tasks end in
    model.weights = fit_logistic(x[order], y[order], p.ridge)
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for each row, from 0 to 1.

    Null, empty or blank text has no hits and gets the score of that.  Null
    identifiers pass through, repeated rows get the same score each, other
    columns are ignored.  Texts are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model)
        for batch in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.score(batch.column("text")), pa.float64())], names=["doc_id", "score"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"cast(`{text_col}` as string) AS text")
    return rows.mapInArrow(run, "doc_id long, score double")
