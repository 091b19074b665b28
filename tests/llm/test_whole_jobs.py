"""Cases in which an operator or stage once did less than its whole job."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from tapeweave.llm import chat, common, exact_dedup, langid, mixing, neardup, pii, spm, sstable, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")


def brute_groups(texts, percent):
    """The smallest identifier of each text's near-duplicate group."""
    sets = {}
    for i, t in texts:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def test_near_stage_links_from_80_percent(spark):
    texts, rng = [], random.Random(8)
    for k in range(40):
        w = [f"g{k}-{i}" for i in range(104)]
        texts.append((10 * k, " ".join(w)))
        for copy in (1, 2):
            for at in rng.sample(range(10, 90, 10), rng.choice([1, 2, 2, 3])):
                w[at] = f"r{k}-{copy}-{at}"
            texts.append((10 * k + copy, " ".join(w)))
    kept = {percent: {i for i, root in brute_groups(texts, percent).items() if i == root} for percent in (80, 85)}
    assert kept[80] < kept[85]
    got = corpus_pipeline.near_dedup_stage(spark, documents(spark, texts), SF)
    assert {r.doc_id for r in got.collect()} == kept[80]


def test_language_stage_rejects_what_was_not_learned(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = {r.lang: r.text for r in corpus.where("length(text) BETWEEN 1500 AND 3000 AND doc_id > 20").orderBy("doc_id").collect()}
    rng = random.Random(1)
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. "
    thai = "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ "
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. "
    junk = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(80))
    gone = [russian, russian * 5, thai, thai * 5, polish, polish * 5, finnish, finnish * 5, junk, russian * 4 + by["en"][:200], by["de"][:100] + " " + junk * 2]
    stay = [*by.values(), by["en"][:700] + " " + by["de"][:700], by["fr"][:500] + "\n" + by["es"][:700], by["en"][:900] + " " + russian, by["en"][:60].rsplit(" ", 1)[0], by["de"][:900] + " " + polish]
    planted = documents(spark, [(10**9 + i, t) for i, t in enumerate(gone + stay)])
    got = corpus_pipeline.language_id(spark, corpus.select(*planted.columns).unionByName(planted.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")), SF)
    left = {r.doc_id - 10**9 for r in got.where("doc_id >= 1000000000").select("doc_id").collect()}
    assert left == set(range(len(gone), len(gone) + len(stay)))
    assert got.where("doc_id < 1000000000").count() >= 0.998 * corpus.count()


def expected_shares(got, dim):
    """Each level's share of the tokens that a sample is expected to hold."""
    expected = F.col("tokens") * F.col("probability")
    rows = got.groupBy(dim).agg(F.sum(expected).alias("t"), F.sum("tokens").alias("all")).collect()
    total = sum(r.t for r in rows)
    return {r[dim]: r.t / total for r in rows}, total / sum(r["all"] for r in rows)


def test_samples_have_the_target_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    targets = corpus_pipeline.LANG_TARGETS
    shares, budget = expected_shares(mixing.mix(docs, mixing.MixParams(targets={"lang": targets})), "lang")
    assert all(abs(shares[k] - v) < 1e-4 for k, v in targets.items()) and 0 < budget <= 0.8


def test_a_rare_topic_does_not_set_what_the_stage_samples(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.measured(docs).groupBy("lang").agg(F.sum("tokens").alias("t")).collect()
    total = sum(r.t for r in rows)
    # what the languages' targets alone allow
    most = min([0.8] + [r.t / total / corpus_pipeline.LANG_TARGETS[r.lang] for r in rows])
    kept = mixing.measured(corpus_pipeline.mix_sources(spark, docs, "")).agg(F.sum("tokens")).first()[0] / total
    assert kept > 0.7 * most  # small cells of three crossed dimensions cost the rest


def test_a_rare_level_raised_severalfold_gets_its_share(spark):
    rows = [(i, "w " * 50, "de" if i % 20 == 0 else "en", "big" if i % 3 == 0 else f"s{i % 7}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="budget is lowered"):
        got = mixing.mix(docs, mixing.MixParams(targets={"lang": {"de": 0.3, "en": 0.7}}))
    assert got.agg(F.max("probability")).first()[0] <= 1
    assert abs(expected_shares(got, "lang")[0]["de"] - 0.3) < 1e-4


def test_contradicting_targets_are_reported(spark):
    rows = [("a", "en", "prose", 100), ("b", "de", "prose", 100)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="contradict"):
        mixing.rake(cells, mixing.MixParams(targets={"lang": {"en": 0.5, "de": 0.5}, "source": {"a": 0.9, "b": 0.1}}))


def chained_texts(n):
    """Texts that share a passage with each other, but few of them 85 %."""
    rng, passage, out = random.Random(5), [f"p{i}" for i in range(70)], []
    for k in range(n):
        own = [f"o{k}-{i}" for i in range(rng.choice([12, 20, 30]))]
        out.append((3 * k, " ".join(passage + own)))
        if k % 6 == 0:
            out.append((3 * k + 1, " ".join([*passage, *own[:-1], "end"])))
    return out


def test_stragglers_meet_in_bounded_blocks(spark):
    rows = [("c", f"n{k:03}", 50, 8, k % 8) for k in range(80)]
    wide = spark.createDataFrame(rows, "cluster string, class string, n_shingles long, blocks int, block int")
    part = spark.createDataFrame([(f"n{k:03}", "n000") for k in range(24)], "node string, root string")
    groups = {}
    for r in neardup._meetings(wide, part, 500, 80).collect():
        groups.setdefault((r.cluster, r.i, r.j), []).append(r)
    assert max(len(g) for g in groups.values()) * 50 <= 4 * 500  # two blocks, dealt by hash
    pairs = Counter()
    for g in groups.values():
        pairs.update(frozenset((a["class"], b["class"])) for a, b in itertools.combinations(g, 2) if {a.side, b.side} in ({0}, {1, 2}))
    main = {f"n{k:03}" for k in range(24)}
    want = {frozenset(x) for x in itertools.combinations([r[1] for r in rows], 2) if not set(x) <= main}
    assert set(pairs) == want and set(pairs.values()) == {1}


def test_chained_texts_equal_brute_force(spark):
    texts = chained_texts(60)
    got = neardup.near_dedup(documents(spark, texts), neardup.NearDupParams(block=700)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_groups(texts, 85)


def test_near_copies_are_removed_by_identifier_and_text(spark):
    w = [f"x{i}" for i in range(100)]
    texts = [(1, " ".join(w)), (2, " ".join([*w[:-1], "end"])), (2, " ".join(f"unique{i}" for i in range(60)))]
    got = neardup.without_near_duplicates(documents(spark, texts))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [texts[0], texts[2]]


def test_rows_without_identifiers_are_linked(spark):
    w = [f"x{i}" for i in range(100)]
    near, far = " ".join([*w[:-1], "end"]), " ".join(f"unique{i}" for i in range(60))
    texts = [(3, " ".join(w)), (None, near), (None, near), (None, far), (3, far)]
    got = sorted((r.n_shingles, r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_dedup(documents(spark, texts)).collect())
    assert got == [(56, 0, 3, False), (56, 3, 3, True), (96, 0, 3, False), (96, 0, 3, False), (96, 3, 3, True)]
    assert sorted(r.doc_id for r in neardup.without_near_duplicates(documents(spark, texts)).collect()) == [3, 3]
    alone = neardup.near_dedup(documents(spark, [(None, " ".join(w)), (None, near)])).collect()
    assert [(r.component_id, r.kept) for r in alone] == [(None, True)] * 2


def test_brute_force_with_null_and_repeated_identifiers(spark):
    texts = chained_texts(40)
    rows = [(None if k % 5 == 0 else i % 31, t) for k, (i, t) in enumerate(texts)]
    got = {(r.doc_id, r.n): r.ids for r in neardup.near_dedup(documents(spark, rows), neardup.NearDupParams(block=700)).groupBy("doc_id", F.lit(0).alias("n")).agg(F.sort_array(F.collect_list("component_id")).alias("ids")).collect()}
    roots = brute_groups(list(enumerate(t for _, t in rows)), 85)
    named = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            named[roots[k]] = min(i, named.get(roots[k], i))
    want = {}
    for k, (i, _) in enumerate(rows):
        if roots[k] in named:
            want.setdefault((i, 0), []).append(named[roots[k]])
    assert got == {k: sorted(v) for k, v in want.items()}


def _held(memory):
    return sum(common.entry_bytes(k, v) for k, v in memory.items())


@pytest.mark.parametrize("kind", ["pieces", "words"])
def test_memories_are_bounded_in_bytes(monkeypatch, kind):
    """Also over texts without white space, in which an entry is a whole text."""
    if kind == "pieces":
        coder, encode = spm.PieceModel(public_tokenizers.path("piece_bpe_32k.model")), lambda texts: coder.encode(pa.array(texts))
    else:
        coder, encode = sstable.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")), lambda texts: coder.encode(pa.array(texts), 1)
    monkeypatch.setattr(type(coder), "MOST", 100_000)
    rng = random.Random(7)
    for at in range(0, 4000, 100):
        encode([f"{i} {i * 7919}" for i in range(at, at + 100)])
        assert max(_held(coder.new), _held(coder.old)) <= 100_000 + 2000
    for _ in range(20):  # 2,000 texts of 5,000 Han characters
        encode(["".join(map(chr, rng.choices(range(0x4E00, 0x9000), k=50))) * 100 for _ in range(100)] if kind == "words" else ["".join(map(chr, rng.choices(range(0x4E00, 0x9000), k=50))) * 10 for _ in range(100)])
        assert max(_held(coder.new), _held(coder.old)) <= 100_000 + 2000
    assert coder.old and coder.new


#: Values of every format that is covered, and what must hold of what stands for them.
PLANTED = [
    "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "FR76 3000 6000 0112 3456 7890 189", "+49 30 1234567", "+49 151 23456789", "06 12 34 56 78",
    "+33 6 12 34 56 78", "020 7946 0958", "3782 822463 10005", "2001:db8::1", "January 3, 2020", "3. Januar 2020", "3 janvier 2020", "3 de enero de 2020", "3rd March 1999", "1er août 2001",
    "4 April 2020", "9 AUGUST 2011", "415-555-2671", "(415) 555-2671", "4111 1111 1111 1111", "2020-01-05", "10.20.30.40", "123-45-6789", "x.y@mail.example.org",
]


@pytest.mark.parametrize("value", PLANTED)
def test_every_covered_format_is_found_whole_and_undone(value):
    p, q = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", back=True)
    for before, after in (("", ""), ("see ", " today"), ("(", ")"), ("\n", "\n"), ("call: ", ", or")):
        text = before + value + after
        new, n = p.replace(text)
        assert n == 1 and new != text and new.startswith(before) and new.endswith(after)
        assert q.replace(new) == (text, 1)
        # the same shape, but for what is written in words or in its shortest form
        if not re.search(r"[a-z]|::|AUGUST|\d\.\d", value):
            assert re.sub("[A-Z]", "A", re.sub("[0-9]", "9", new)) == re.sub("[A-Z]", "A", re.sub("[0-9]", "9", text))


def test_account_numbers_stay_valid_and_linked():
    p = pii.Pseudonyms(b"k")
    spaced, compact = p.replace("DE89 3704 0044 0532 0130 00")[0], p.replace("DE89370400440532013000")[0]
    assert spaced.replace(" ", "") == compact and pii._account_check(compact) == 1 and compact[:2] == "DE"
    # a group of letters behind it is text; a card behind something like one is a card
    assert p.replace("GB29 NWBK 6016 1331 9268 19 BANK")[0].endswith(" BANK")
    assert p.replace("AB12 4111 1111 1111 1111")[0] == "AB12 " + p.replace("4111 1111 1111 1111")[0]
    assert p.replace("DE88 3704 0044 0532 0130 00")[0].startswith("DE88 ")


@pytest.mark.parametrize("text", ["12:30:45", "std::vector", "a::b", "ratio 16:9:4", "31 February 2020", "4th March 19", "3th March 1999", "+12 34", "DE89"])
def test_what_is_no_value_stays(text):
    assert pii.Pseudonyms(b"k").replace(text) == (text, 0)


def test_dates_in_words_are_one_to_one():
    p = pii.Pseudonyms(b"k")
    days = [(y, m, d) for y in (1999, 2020) for m in range(1, 13) for d in range(10, 29)]
    for shape in ("{d} {n} {y}", "{n} {d}, {y}"):
        new = {p.replace(shape.format(d=d, n=pii.MONTHS["en"][m - 1], y=y))[0] for y, m, d in days}
        assert len(new) == len(days)


def test_registered_pseudonyms_are_the_same_in_every_run(spark):
    from conftest import SF

    from tapeweave.llm.queries import QUERIES

    a, b = (sorted(map(tuple, QUERIES["op4_feistel_pseudonyms"](spark, SF).collect()), key=repr) for _ in "ab")
    assert a == b and any(n for _, _, n in a)


@pytest.mark.parametrize(("text", "values"), [
    ("2024-01-05T10:00:00Z", ["2024-01-05"]), ("Tel.415-555-2671", ["415-555-2671"]), ("415-555-2671/415-555-2672", ["415-555-2671", "415-555-2672"]),
    ("card-4111111111111111", ["4111111111111111"]), ("http://10.1.2.3/a", ["10.1.2.3"]), ("2024-01-05/2024-02-05", ["2024-01-05", "2024-02-05"]), ("id/123-45-6789/", ["123-45-6789"]),
    ("1.2.3.4.5", []), ("5-415-555-2671", []), ("1/2/2020/7", []), ("2024-01-05Tuesday", []), ("0.123456789", []),
])
def test_values_beside_marks_are_found(text, values):
    p, q = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", back=True)
    want = text
    for v in values:
        want = want.replace(v, p.replace(v)[0])
    assert p.replace(text) == (want, len(values)) and q.replace(want) == (text, len(values))


def test_every_email_of_a_long_text_counts():
    p = pii.Pseudonyms(b"k")
    alone = p.replace("4155552671@x.com")[0]
    text, n = p.replace(" ".join(["a@b.org"] * 1000 + ["4155552671@x.com"]))
    assert n == 1001 and text.endswith(" " + alone)


def test_planted_values_are_found_where_they_stand():
    rng, p = random.Random(4), pii.Pseudonyms(b"k")
    values = {"2024-01-05": "date", "5/6/1987": "date", "10.20.30.40": "ip", "123-45-6789": "ssn", "415-555-2671": "phone", "4111 1111 1111 1111": "card", "GB82WEST12345698765432": "iban", "a" * 16 + "0" * 16: "secret", "x.y@mail.example.org": "email", "123456789012": "number"}
    for _ in range(300):
        text, want = "", []
        for _ in range(rng.randint(1, 12)):
            text += rng.choice(["word ", "see: ", "(", "\n", "call, ", "12 of 34 ", "v1.2 ", "É "])
            value = rng.choice(list(values))
            want.append((len(text), len(text) + len(value), values[value]))
            text += value + rng.choice([" ", ", ", ") ", "\n", "; ", "! "])
        assert p.find(text) == want


def test_apostrophes_open_no_quotation():
    quoted = toxicity.inside_quotation
    assert not quoted(["you", "don’t", "know,"]) and not quoted(["the", "dogs’", "owner"]) and not quoted(["l’homme", "d’ici"])
    assert quoted(["he", "said", "‘you"]) and not quoted(["he", "said", "‘no’", "and"]) and quoted(["„du"]) and not quoted(["„du", "da“"])
    model = toxicity.ToxicityModel({"idiot": 5.0}, {}, weights=np.array([-4.0, 0, 0, 0, 2.0, 0, 0, 0, 0]))
    a, b = toxicity.Scorer(model).score(pa.array(["you don't know, idiot", "you don’t know, idiot"]))
    assert a == b


def test_labels_that_disagree_do_not_depend_on_order(spark):
    texts = [(i, f"w{i} common words here w{i % 7} " + ("you" + str(i) + " idiot" if i % 3 == 0 else "fine day")) for i in range(240)]
    labels = [(i, 1 if i % 3 == 0 else 0) for i in range(240)] + [(0, 0)]
    made = [toxicity.train(documents(spark, texts[::way]), spark.createDataFrame(labels[::way], "doc_id long, toxic int")) for way in (1, -1)]
    assert made[0].words == made[1].words and "idiot" in made[0].words and np.array_equal(made[0].weights, made[1].weights)


def test_viterbi_with_very_many_languages():
    scores = -np.ones((3, 300))
    scores[:, 290] = 0
    assert langid.viterbi(scores, np.array([0, 3]), 2.0).tolist() == [290] * 3


def test_switches_of_language(spark):
    rows = [(i, "alpha beta gamma delta " * 40 if i % 2 else "ωμέγα λόγος άνθρωπος κόσμος " * 40) for i in range(20)]
    docs = documents(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("el"))
    model = langid.train(docs)
    mixed = documents(spark, [(1, "alpha beta ωμέγα λόγος gamma"), (2, "alpha"), (3, None), (4, "")])
    got = {r.doc_id: (r.lang_pred, r.n_spans, r.switches) for r in langid.identify(mixed, langid.LangModel(model.langs, model.scores, model.scripts, langid.LangIdParams(switch=1.0))).collect()}
    assert got == {1: ("en", 3, [2, 4]), 2: ("en", 1, []), 3: ("und", 0, []), 4: ("und", 0, [])}


def test_chats_with_clashing_columns_and_a_very_long_turn(spark):
    long = "x" * 2_000_000
    rows = [(1, 0, "user", long, 5, 6, "h"), (2, 0, "user", long, 7, 8, "h"), (2, 1, "bot", "ok", 0, 0, "g")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int, one int, h1 string").withColumns({"tie": F.lit(1), "conv": F.lit("c"), "r_one": F.lit(2), "n_turns": F.lit(3)})
    got = chat.chat_format(df).collect()
    assert [(r.conv_id, r.part, r.n_turns, r.n_copies, len(r.text)) for r in got] == [(2, 0, 2, 1, 2_000_000 + len("<|user|>\n<|end|>\n<|bot|>\nok<|end|>\n"))]


@pytest.mark.parametrize(("parts", "want"), [(1, 1), (2, 1), (13, 4), (16, 4), (17, 5)])
def test_rounds_are_binomial(spark, parts, want):
    rows = exact_dedup.digests(documents(spark, [(i, f"text {i % 40}") for i in range(200)])).repartition(parts)
    rounds = []
    written = common.cut(rows.withColumn("p", F.spark_partition_id())).repartition(parts, "p").drop("p")
    got = exact_dedup.merge_runs(written, 200, rounds=rounds)
    assert got.count() == 40 and rounds[0] <= want and (parts < 3 or rounds[0] > 1)


@pytest.mark.parametrize(("fan", "parts", "keep"), [(2, 13, "largest"), (16, 13, "smallest"), (3, 1, "largest")])
def test_merged_runs_equal_brute_force(spark, monkeypatch, fan, parts, keep):
    monkeypatch.setattr(exact_dedup, "CHUNK", 50)  # many chunks and slices
    monkeypatch.setattr(exact_dedup, "SLICE", 64)
    rng = random.Random(fan)
    texts = [None, "", "A", "a", *(f"t{i}" for i in range(300))]
    rows = [(None if rng.random() < 0.1 else rng.randint(-50, 400), rng.choice(texts)) for _ in range(2000)] + [(7, "hot")] * 1000
    groups, best = {}, max if keep == "largest" else min
    for i, t in rows:
        groups.setdefault((t or "").lower(), []).append(i)
    kept = {t: best((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, kept[t], len(groups[t]), i == kept[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in ((i, (t or "").lower()) for i, t in rows))
    assert Counter(map(tuple, exact_dedup.exact_dedup(documents(spark, rows).repartition(parts), keep=keep, fan=fan).collect())) == want


def test_which_of_repeated_rows_stays_does_not_depend_on_order(spark):
    rows = [(1, t, x) for t in "aA" for x in (1.0, 2.0, 3.0)]
    left = [exact_dedup.deduplicated(spark.createDataFrame(rows[::way], "doc_id long, text string, x double")).collect() for way in (1, -1)]
    assert left[0] == left[1] and len(left[0]) == 1


def test_byte_pieces_and_literal_marks_are_on_the_best_path():
    model = spm.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    scores, rng = {v[0]: v[2] for _, v in model.automaton.items()}, random.Random(6)
    pieces = {k: v[2] for k, v in model.automaton.items()}
    byte = {int(i): b for b, i in enumerate(model.byte)}
    for _ in range(300):
        text = "".join(rng.choice(["a", "the", "▁", "𐍈", "🙂", "é", " ", "語", "\n", "\u0301", "12"]) for _ in range(rng.randint(1, 25)))
        form = " " + text
        best = [0.0] + [-1e300] * len(form)
        inner = form.replace("▁", "\udc81").replace(" ", "▁")
        for end in range(1, len(form) + 1):
            for start in range(max(0, end - 48), end):
                if inner[start:end] in pieces:
                    best[end] = max(best[end], best[start] + pieces[inner[start:end]])
            if inner[end - 1] not in pieces:
                best[end] = max(best[end], best[end - 1] + model.unknown)
        ids, bounds = model.encode(pa.array([text]))
        total = sum(scores[i] if i in scores else model.unknown * (byte[i] & 0xC0 != 0x80) for i in ids.tolist())
        assert abs(total - best[-1]) < 1e-6 * abs(best[-1])
        assert model.decode(ids.astype(np.int64), bounds)[0].tobytes().decode() == text


def test_ids_equal_the_tokenizers_on_the_corpus_and_for_other_files(spark, tmp_path):
    from tokenizers import Tokenizer, normalizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    other = Tokenizer.from_file(path)
    other.normalizer = normalizers.Strip()
    other.save(f"{tmp_path}/other.json")
    for file in (path, f"{tmp_path}/other.json"):
        plain, coder = Tokenizer.from_file(file), sstable.WordTokenizer(file)
        assert coder.by_word == (file == path)
        ids, bounds = coder.encode(pa.array(texts), 1)
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]
