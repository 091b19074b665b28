"""Spelling variants of a corpus's words, grouped under their common form.

Two words one edit apart share a half: the edit lies in one of the two segments
of either word, so the other segment stands unchanged at the same end of the
other word.  Shards of the segments are built into Aho-Corasick automata; every
word is scanned by each shard that holds a segment it could contain at a fitting
place, and occurrences at a fitting offset, of words of a fitting length, are
verified on the rest of the word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, cut

#: Words longer than this are compared one by one with the few that share a
#: half of theirs; shorter ones are looked up by what is left without one letter.
LONG = 64


@dataclass(frozen=True)
class SpellingParams:
    """``min_chars``/``min_count``: what makes a word; ``times``: how much more
    frequent a form must be.  ``shard_rows``: words (with their visits) that a
    shard holds on average; ``bucket``: entries of one segment in one shard.
    ``slips``: of the occurrences whose draw this number divides, one letter is
    lost (test noise); None: texts as they are."""

    min_chars: int = 5
    min_count: int = 3
    times: int = 2
    shard_rows: int = 100_000
    bucket: int = 20_000
    slips: int | None = None


def word_counts(docs: DataFrame, params: SpellingParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: how often each word occurs in all texts.

    A word is a maximal run of Latin letters (to U+00FF), A-Z lower-cased.
    Counted inside tasks before the shuffle, all in the JVM.
    """
    runs = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long").cast("string"), F.lit("null")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("run"),
    ).select("id", F.translate("run", ASCII_UPPER, ASCII_LOWER).alias("word"))
    if params.slips:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word")))
        lost = F.expr("concat(substring(word, 1, CAST(h % char_length(word) AS int)), substring(word, CAST(h % char_length(word) AS int) + 2))")
        runs = runs.withColumn("word", F.when(F.col("h") % params.slips == 0, lost).otherwise(F.col("word")))
    counts = runs.where(F.char_length("word") >= params.min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= params.min_count)


def _one_apart(a: str, b: str) -> bool:
    """Whether ``a`` and ``b`` differ by one inserted, deleted or replaced letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


class _Rests:
    """What the words with one segment and one length have beside it, ready to
    be met by rests one edit away."""

    def __init__(self) -> None:
        self.whole: dict[str, int] = {}
        self.without: list[dict[str, list[int]]] = []

    def add(self, rest: str, entry: int, long: bool) -> None:
        self.whole[rest] = entry
        if long:
            return
        while len(self.without) < len(rest):
            self.without.append(defaultdict(list))
        for i in range(len(rest)):
            self.without[i][rest[:i] + rest[i + 1 :]].append(entry)

    def near(self, rest: str, longer_by: int, rests: dict[int, str], long: bool) -> Iterator[int]:
        """Entries one edit from ``rest``, which is ``longer_by`` letters longer
        than theirs; each once."""
        if long:
            yield from (k for r, k in self.whole.items() if _one_apart(r, rest))
        elif longer_by == 0:
            for i, level in enumerate(self.without):
                for k in level.get(rest[:i] + rest[i + 1 :], ()):
                    if rests[k][i] != rest[i]:
                        yield k
        elif longer_by == 1:
            for i in range(len(rest)):
                # of equal neighbours only the first is taken out
                if i == 0 or rest[i] != rest[i - 1]:
                    k = self.whole.get(rest[:i] + rest[i + 1 :])
                    if k is not None:
                        yield k
        else:
            for i, level in enumerate(self.without):
                for k in level.get(rest, ()):
                    if i == 0 or rests[k][i] != rests[k][i - 1]:
                        yield k


class SegmentShard:
    """An automaton over segments, with the words they were cut from.

    ``add`` takes a word and which of its segments this shard holds; ``scan``
    gives the held words one edit from a word, each once over all shards: by
    the right segment only where the left one does not stand in it too.
    """

    def __init__(self) -> None:
        self.words: list[str] = []
        self._rests: dict[str, dict[tuple[bool, int], _Rests]] = defaultdict(dict)
        self._rest_of: dict[tuple[bool, int], dict[int, str]] = defaultdict(dict)
        self._automaton = None

    def add(self, word: str, left: bool) -> int:
        half = len(word) // 2
        segment, rest = (word[:half], word[half:]) if left else (word[half:], word[:half])
        self.words.append(word)
        entry, kind = len(self.words) - 1, (left, len(word))
        self._rests[segment].setdefault(kind, _Rests()).add(rest, entry, len(word) > LONG)
        self._rest_of[kind][entry] = rest
        return entry

    def scan(self, word: str) -> Iterator[int]:
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for segment in self._rests:
                self._automaton.add_word(segment, segment)
            self._automaton.make_automaton()
        n = len(word)
        for end, segment in self._automaton.iter(word):
            at_start, at_end = end + 1 == len(segment), end + 1 == n
            if not (at_start or at_end):
                continue
            for (left, size), rests in self._rests[segment].items():
                if abs(n - size) > 1 or not (at_start if left else at_end):
                    continue
                rest = word[len(segment) :] if left else word[: n - len(segment)]
                own = self._rest_of[left, size]
                for k in rests.near(rest, n - size, own, size > LONG):
                    if left or not word.startswith(own[k]):
                        yield k


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Count the near words of each word whose segment lies in this shard, and
    find the most frequent of them."""
    shard = SegmentShard()
    counts: dict[str, int] = {}
    for word, n, own in zip(rows["word"], rows["n"], rows["own"], strict=True):
        counts[word] = n
        if own:
            shard.add(word, own == 1)
    near = [0] * len(shard.words)
    best: list[tuple[int, str] | None] = [None] * len(shard.words)
    if shard.words:
        for word, n in counts.items():
            rank = (-n, word)
            for k in shard.scan(word):
                near[k] += 1
                if best[k] is None or rank < best[k]:
                    best[k] = rank
    return pd.DataFrame(
        {
            "word": shard.words,
            "n": pd.Series([counts[w] for w in shard.words], dtype="int64"),
            "n_near": pd.Series(near, dtype="int64"),
            "best_n": pd.Series([None if b is None else -b[0] for b in best], dtype="Int64"),
            "best": pd.Series([None if b is None else b[1] for b in best], dtype="object"),
        }
    )


def near_words(vocabulary: DataFrame, params: SpellingParams | None = None) -> DataFrame:
    """Per word of ``vocabulary(word, n)``: its number of words one edit away,
    and the most frequent of them (``best``, ``best_n``; ties: the smallest).

    A word visits the shards of the segments that words of its length, or one
    more or less, could share with it: six at most.  A segment with more than
    ``bucket`` words has its entries dealt in several shards, all of which are
    visited; such segments are fewer than two words in ``bucket``, and that list
    alone is broadcast.  No pair is ever shuffled: a shard gives one row for each
    of its entries, two for each word.
    """
    p = params or SpellingParams()
    size = "char_length(word)"
    visits = (
        vocabulary.select("word", "n", F.explode(F.expr(f"sequence(greatest({size} - 1, 2), {size} + 1)")).alias("of"))
        .withColumn("half", F.expr("of div 2"))
        .select(
            "word", "n", "of",
            F.explode(F.expr(f"""array(
                struct(1 AS side, if(half <= {size}, substring(word, 1, CAST(half AS int)), NULL) AS segment),
                struct(2 AS side, if(of - half <= {size}, right(word, CAST(of - half AS int)), NULL) AS segment))""")).alias("s"),
        )
        .select("word", "n", "of", "s.side", "s.segment", F.expr(f"if(of = {size}, s.side, 0)").alias("own"))
        .where("segment IS NOT NULL")
    )
    key = ["side", "of", "segment"]
    wide = visits.where("own > 0").groupBy(*key).count().where(F.col("count") > p.bucket).select(*key, F.ceil(F.col("count") / p.bucket).cast("int").alias("parts"))
    dealt = visits.join(F.broadcast(wide), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.explode(F.expr("if(own > 0 OR parts = 1, array(CAST(pmod(xxhash64(word), parts) AS int)), sequence(0, parts - 1))")))
    # an entry is scanned by the other parts of its segment as well
    again = dealt.where("own > 0 AND parts > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).where("other <> part")
    dealt = dealt.unionByName(again.withColumn("part", F.col("other")).drop("other").withColumn("own", F.lit(0)))
    n_shards = max(int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-6 * vocabulary.count() // p.shard_rows))
    rows = dealt.select(F.expr(f"pmod(xxhash64(side, of, segment, part), {n_shards})").alias("shard"), "word", "n", "own")
    found = rows.groupBy("shard").applyInPandas(_shard, "word string, n long, n_near long, best_n long, best string")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    return found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """``forms(word, form)`` as ``(word, root)``: the end of the chain of forms,
    the word itself if it has none.

    Pointers of words with a form are doubled until none moves.  A form is more
    frequent than its word, so chains end, and their length is at most the
    logarithm of the largest count; rounds grow with the logarithm of that.
    """
    at = cut(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    moving = not at.isEmpty()
    while moving:
        hop = at.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = cut(at.join(hop, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        moving = not moved.where("moved").isEmpty()
        at = moved.select("word", "root")
    return forms.where("form IS NULL").select("word", F.col("word").alias("root")).unionByName(at)


def spelling_groups(docs: DataFrame, params: SpellingParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of all texts with their form and root: ``(word, form, root, n,
    n_near, form_n)``.

    A word's form is the most frequent word one edit away (ties: the smallest in
    code-point order) if that is at least ``times`` as frequent, else null; its
    root is the end of the chain of forms, the word itself if it has none.

    Null and empty texts have no words; a null identifier draws as ``null``
    where ``slips`` are asked for; repeated rows count each; other columns are
    ignored; an empty table gives an empty one.  Words of any length are taken.
    """
    p = params or SpellingParams()
    vocabulary = cut(word_counts(docs, p, id_col, text_col))
    near = near_words(vocabulary, p)
    fits = F.col("best_n") >= p.times * F.col("n")
    formed = cut(near.select("word", "n", "n_near", F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")))
    return formed.join(roots(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")
