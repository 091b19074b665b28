"""Text operators against brute force, exact round trips and edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tapeweave.llm import chat, exact_dedup, langid, mixing, neardup, pii, quality_suffix, spm, sstable, toxicity  # noqa: E402
from tapeweave.llm.common import Words, components, join_by_key, slices  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, class string, run int, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}" for i in range(60_000))


def docs(spark, rows):
    """Documents with columns whose names clash with operators' own."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), None, "c", 7, 0.5) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, tiny, long, repeated and equal texts; null identifiers."""
    return docs(spark, [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, "Hello", "en", None), (5, "hello", "en", "b"), (6, LONG, "en", "a"),
        (7, "the same text twice here and now", "en", "a"), (7, "the same text twice here and now", "en", "a"), (None, "the same text twice here and now", "en", "a"), (8, "日本語 テキスト é ▁x <|endoftext|>", "ja", "b"),
    ])


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return WORD.findall(text or "")


def test_words_are_the_contracts_words():
    texts = ["a  b\x0bc", "", None, " x y", " é\n", "z"]
    w = Words(pa.array(texts))
    flat = w.array().to_pylist()
    assert [flat[a:b] for a, b in itertools.pairwise(w.first)] == [words(t) for t in texts]
    assert [b.num_rows for b in slices(iter([pa.RecordBatch.from_arrays([pa.array(["a" * 10] * 5 + ["b" * 99, None])], names=["t"])]), "t", 25)] == [2, 2, 1, 1, 1]


def test_components_and_hot_join(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (9, 8), (10, 3), (8, 7), (50, 50)], "u long, v long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (10, 1), (7, 7), (8, 7), (9, 7)}
    assert components(edges.limit(0)).count() == 0
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert join_by_key(rows, facts, "k", "n", 3000).count() == 3000


# 1


def brute_repeats(w):
    return [max((sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(w[i:], w[j:]))) for j in range(len(w)) if j != i), default=0) for i in range(len(w))]


def test_repeat_lengths_equal_brute_force():
    random.seed(4)
    for _ in range(40):
        texts = [" ".join(random.choice("ab" if k else "abcdefghij") for _ in range(random.choice([0, 1, 5, 30, 60]))) for k in range(3)]
        m = quality_suffix.measure(pa.array(texts))
        for k, t in enumerate(texts):
            got = m["lengths"][m["first"][k] : m["first"][k + 1]]
            want = np.array(brute_repeats(t.split()), dtype=int)
            assert (got[want >= 4] == want[want >= 4]).all() and (got[want < 4] < 4).all()


def test_repetition_rules(spark, odd):
    block = " ".join(f"x{i}" for i in range(60))
    clean = " ".join(f"y{i}" for i in range(800))
    df = odd.unionByName(docs(spark, [(20, f"{block} {clean} {block}", "en", "a"), (21, clean, "en", "a"), (22, f"{clean}\n{clean}", "en", "a")]))
    got = {r.doc_id: r for r in quality_suffix.repetition_rules(df).collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[6].base_failed and got[6].longest_repeat == 60_000 - 997
    assert not got[20].base_failed and got[20].longest_repeat == 60 and not got[20].kept
    assert got[21].kept and got[22].base_failed and got[22].n_dup_lines == 1
    assert quality_suffix.repetition_rules(odd).count() == 10 and quality_suffix.repetition_rules(odd.limit(0)).count() == 0


# 2


def shingle_set(text):
    w = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, sets


def test_sketches_agree_as_often_as_sets_do():
    rng = np.random.default_rng(0)
    agree = []
    for _ in range(40):
        a = rng.integers(0, 2**63, 40, dtype=np.uint64)
        b = np.concatenate([a[:30], rng.integers(0, 2**63, 10, dtype=np.uint64)])
        s = neardup.sketches([np.unique(a), np.unique(b), a[:1]], 192)
        assert (s[:3] != np.iinfo(np.uint64).max).all()
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - 0.6) < 0.03


def near_texts(n, seed=3):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"r{rng.randrange(10**6)}"
        out.append((100 + k, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [400_000, 1500])
def test_near_groups_equal_brute_force(spark, block):
    rows = near_texts(90) + [(i, " ".join(f"u{i}-{j}" for j in range(30))) for i in range(10)]
    got = {r.doc_id: r for r in neardup.near_dedup(docs(spark, [(i, t, "en", "a") for i, t in rows]), neardup.NearDupParams(block=block)).collect()}
    want, sets = brute_components(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(s) and got[i].kept == (want[i] == i) for i, s in sets.items())


def test_near_dedup_of_odd_rows(spark, odd):
    got = neardup.near_dedup(odd).collect()
    assert len(got) == 10 and sum(r.doc_id == 7 and r.kept for r in got) == 2
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[2].component_id == 2
    assert by[4].component_id == by[5].component_id == 4 and by[None].component_id == 7
    assert neardup.near_dedup(odd.limit(0)).count() == 0
    assert neardup.without_near_duplicates(odd).columns == odd.columns


def test_near_groups_of_the_corpus(spark, corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    want, _ = brute_components(rows)
    assert {r.doc_id: r.component_id for r in neardup.near_dedup(corpus).collect()} == want


# 3


def chat_rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_snapshots_collapse(spark, monkeypatch):
    a = [(0, "user", "hi"), (1, "assistant", "yo <|end|>"), (2, "user", "ok")]
    rows = [(c, t, r, x) for c, upto in ((1, 1), (2, 2), (3, 3), (4, 3)) for t, r, x in a[:upto]] + [(5, 0, "user", "hi!"), (6, None, "user", "lost"), (None, 0, "user", "lost"), (5, 0, "user", "hi!")]
    rows += [(9, t, None, None) for t in range(3)]
    got = {r.conv_id: r for r in chat.chat_format(chat_rows(spark, rows)).collect()}
    assert set(got) == {3, 5, 9} and got[3].n_copies == 2 and got[3].n_turns == 3
    assert got[3].text == "<|user|>\nhi<|end|>\n<|assistant|>\nyo < |end|><|end|>\n<|user|>\nok<|end|>\n"
    assert chat.chat_format(chat_rows(spark, [])).count() == 0


def test_long_conversations_come_in_parts(spark):
    rows = [(1, t, "user", str(t)) for t in range(600)] + [(2, t, "user", str(t)) for t in range(300)]
    got = chat.chat_format(chat_rows(spark, rows)).orderBy("part").collect()
    assert [(r.conv_id, r.part, r.n_turns) for r in got] == [(1, 0, 600), (1, 1, 600), (1, 2, 600)]
    assert "".join(r.text for r in got) == "".join(f"<|user|>\n{t}<|end|>\n" for t in range(600))


# 4


def test_pseudonyms_are_bijective_valid_and_reversible(spark, odd):
    p, q = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", back=True)
    values = {"date": ["2024-02-29", "1850-1-3", "31/12/1999", "3/4/2020"], "ip": ["1.2.3.4"], "card": ["4111 1111 1111 1111"], "number": ["9807915762804490", "123456789"], "ssn": ["123-45-6789"],
              "phone": ["+1 (017) 555-7713"], "iban": ["DE89370400440532013000"], "email": ["john.Doe7@x.org"], "secret": ["ab" * 20]}
    for kind, own in values.items():
        for v in own:
            new = p.one(kind, v)
            assert new != v and q.one(kind, new) == v and re.sub(r"[0-9]", "9", re.sub("[a-zA-Z]", "a", new)) == re.sub(r"[0-9]", "9", re.sub("[a-zA-Z]", "a", v)) or kind in ("ip", "date", "secret", "email")
    new = p.one("card", "4111111111111111")
    assert pii.luhn_digit(new[:-1]) == int(new[-1])
    assert p.one("date", "2023-02-29") is None and p.one("ip", "1.2.3.400") is None
    perm = pii.Permutation(b"x")
    for size in (1, 2, 10, 97):
        assert sorted(perm(i, size, b"t") for i in range(size)) == list(range(size))
    df = odd.unionByName(docs(odd.sparkSession, [(30, "card 4111111111111111, again 4111111111111111; year 2024 stays", "en", "a")]))
    got = {r.doc_id: r for r in pii.pseudonymise(df, "key").collect()}
    assert got[1].text is None and got[2].text == "" and got[6].text == LONG
    found = re.findall(r"\d{16}", got[30].text)
    assert got[30].n_values == 2 and found[0] == found[1] != "4111111111111111" and "2024" in got[30].text
    back = pii.pseudonymise(pii.pseudonymise(df, "key"), "key", back=True).where("doc_id = 30").first().text
    assert back == df.where("doc_id = 30").first().text
    assert pii.pseudonymise(odd.limit(0), "key").count() == 0


# 5


def distance(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    lexicon = {w: 1.0 for w in ["idiot", "moron", "scum", "worthless", "disgusting", "abab", "ababababa"]}
    automaton = toxicity.LexiconAutomaton(lexicon, {"stup": 1.0})
    for _ in range(1500):
        w = list(rng.choice(list(lexicon)))
        for _ in range(rng.randint(0, 3)):
            i, kind = rng.randrange(len(w)), rng.randrange(4)
            if kind == 0 and len(w) > 1:
                w.pop(i)
            elif kind == 1:
                w.insert(i, rng.choice("abidot"))
            elif kind == 2:
                w[i] = rng.choice("abidot")
            elif i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
        w = "".join(w)
        best = min((distance(w, t) for t in lexicon if distance(w, t) <= toxicity.edits(t)), default=None)
        got = automaton.match(w)
        assert (got[1] if got else None) == best
    assert automaton.match("stupidest") == ("stem", 0, "stup")


def test_context_and_scores(spark, odd):
    model = toxicity.ToxicityModel({"idiot": 5.0}, {}, weights=np.array([-4.0, 0, 0, 0, 2.0, 0, 0, 0, 0]))
    score = dict(zip("abcde", toxicity.Scorer(model).score(pa.array(["you are an idiot", 'he said the word "idiot" was used', "a fine day", "you are an idoit", None]))))
    assert score["a"] > score["d"] > score["c"] == score["e"] and score["a"] > score["b"]
    got = toxicity.score(odd, model).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    blind = toxicity.train(odd, spark.createDataFrame([(4, 0), (None, 1), (5, None)], "doc_id long, toxic int"))
    assert {round(r.score, 4) for r in toxicity.score(odd, blind).collect()} == {0.0025}


# 6


def test_raking_meets_the_targets(spark):
    cells = [("s1", "en", "prose", 500), ("s1", "de", "prose", 100), ("s2", "en", "list", 300), ("s2", "de", "prose", 50), ("s2", "de", "list", 50)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    p = mixing.MixParams(targets={"lang": {"en": 0.5, "de": 0.5}, "source": {"s1": 0.6, "s2": 0.4}, "topic": {"prose": 0.7, "list": 0.3}}, rounds=40)
    got = mixing.rake(df, p).collect()
    for dim, want in p.targets.items():
        for level, share in want.items():
            assert abs(sum(r.weight for r in got if r[dim] == level) - share) < 1e-6


def test_mix_of_odd_rows(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == 10 and all(0 <= r.probability <= 1 for r in got)
    assert {r.doc_id: r.tokens for r in got}[6] == 60_000
    assert mixing.mix(odd.limit(0)).count() == 0
    kept = mixing.sampled(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.sampled for r in got)


# 7


def test_shards_round_trip(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = sstable.write_shards(odd, f"file://{tmp_path}/s", path, sstable.ShardParams(block_bytes=64, shard_bytes=4096))
    plain = Tokenizer.from_file(path)
    want = Counter((r.doc_id, tuple([*plain.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in odd.collect())
    rows = sstable.read_shards(manifest).orderBy("start").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in rows], key=lambda x: (x is not None, x or 0))
    assert [r.start for r in rows] == [0, *np.cumsum([len(r.ids) for r in rows])[:-1]]
    digests = {r.start: r for r in sstable.shard_digests(manifest).collect()}
    assert all(digests[r.start].ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in rows)
    readers = [sstable.ShardReader(r.path) for r in manifest.collect()]
    found = Counter((i, tuple(x.tolist())) for i in (None, 1, 2, 3, 4, 5, 6, 7, 8) for r in readers for x in r.get(i))
    assert found == want and not any(r.get(i) for r in readers for i in (-5, 0, 99))
    empty = sstable.write_shards(odd.limit(0), f"file://{tmp_path}/e", path)
    assert empty.count() == 0 and sstable.shard_digests(empty).count() == 0


def test_keys_keep_the_order_of_identifiers():
    ids = [-(2**63), -1, 0, 1, 255, 256, 2**63 - 1]
    keys = [sstable.key_of(i) for i in ids]
    assert keys == sorted(keys) and [sstable.ident_of(k) for k in keys] == ids and sstable.key_of(None) < keys[0]


# 8


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        first = np.concatenate(([0], np.cumsum(rng.integers(0, 6, 4))))
        scores = -rng.random((first[-1], 3)) * 5
        label = langid.viterbi(scores, first, 2.0)
        for a, b in itertools.pairwise(first):
            if a < b:
                value = lambda p: sum(scores[a + i, k] for i, k in enumerate(p)) - 2.0 * sum(x != y for x, y in itertools.pairwise(p))  # noqa: B023, E731
                assert abs(max(map(value, itertools.product(range(3), repeat=b - a))) - value(label[a:b])) < 1e-9


def test_languages_of_held_out_and_odd_rows(spark, odd, corpus):
    held = "crc32(cast(doc_id AS string)) % 4 = 2"
    model = langid.train(corpus.where(f"NOT {held}"))
    got = langid.identify(corpus.where(held), model).join(corpus.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.93
    by = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0 and by[4].lang_pred in model.langs
    spans = langid.spans(odd, model).where("doc_id = 6").collect()
    assert sum(s.n_words for s in spans) == 60_000
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3})
    assert langid.identify(odd.limit(0), model).count() == 0
    nothing = langid.train(odd.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"} and langid.spans(odd, nothing).count() == 0


# 9


def brute_viterbi(model, text):
    """Best total score over all segmentations, by dynamic programming over a dictionary."""
    pieces = {k: v[2] for k, v in model.automaton.items()}
    best = [0.0] + [-1e300] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 48), end):
            s = pieces.get(text[start:end])
            if s is not None:
                best[end] = max(best[end], best[start] + s)
        if text[end - 1] not in pieces:
            best[end] = max(best[end], best[end - 1] + model.unknown)
    return best[-1]


def test_pieces_are_the_best_path_and_decode_exactly(spark, odd, corpus):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = spm.piece_model(path)
    scores = {v[0]: v[2] for _, v in model.automaton.items()}
    for text in ["hello world", " a  b\n\nc ", "naïve façade 123", "日本", *[r.text[:300] for r in corpus.limit(20).collect()]]:
        ids, _ = model.encode(pa.array([text]))
        total = sum(scores.get(i, 0) for i in ids.tolist())
        n_bytes = sum(i not in scores for i in ids.tolist())
        if not n_bytes:
            assert total == brute_viterbi(model, "▁" + text.replace(" ", "▁"))
    got = spm.encoding_digests(odd, path).collect()
    assert len(got) == 10 and all(r.round_trip for r in got) and {r.doc_id: r.n_tokens for r in got}[1] == 0
    back = spm.decode(spm.encode(odd, path), path).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert spm.encode(odd.limit(0), path).count() == 0


# 10


def test_exact_groups(spark, odd):
    got = exact_dedup.exact_dedup(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 10 and by[1].keep_id == by[2].keep_id == 2 and by[4].keep_id == 5 and by[None].keep_id == 7 and by[None].group_size == 3
    assert by[5].text_sha256 == hashlib.sha256(b"hello").hexdigest() and not by[4].kept and by[5].kept
    assert exact_dedup.exact_dedup(odd, keep="smallest").where("doc_id = 4").first().kept
    small = exact_dedup.deduplicated(odd)
    assert small.columns == odd.columns and sorted(r.doc_id for r in small.collect()) == [2, 3, 5, 6, 7, 8]
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0 and exact_dedup.deduplicated(odd.limit(0)).count() == 0
    wide = spark.range(400).select("id", F.lit("x").alias("text")).repartition(13)
    assert exact_dedup.exact_dedup(wide, id_col="id", fan=2).where("kept AND group_size = 400 AND keep_id = 399").count() == 1
