"""Registered queries of the text operators, with oracle SQL where SQL can say it.

Each query reads its whole table and derives the contract's columns from what
its operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_suffix import repetition_rules

    return repetition_rules(_documents(spark, sf_dir)).drop("longest_repeat")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_dedup

    return near_dedup(_documents(spark, sf_dir))


def op3_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_format

    return chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Key of the registered query where none is set: known to everybody, so that
#: its result can be compared and a retried run links with the first.  Real
#: data need a secret of their own.
PII_TEST_KEY = "tapeweave-known-test-key"


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    # the name makes Spark hide the value
    key = spark.conf.get("spark.tapeweave.pii.secret", None) or PII_TEST_KEY
    return pseudonymise(_documents(spark, sf_dir), key)


def op5_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("crc32(cast(doc_id AS string)) % 3 <> 1")
    got = score(docs, train(docs, labels))
    return got.selectExpr("doc_id", "crc32(cast(doc_id AS string)) % 3 = 1 AS held_out", "score", "CASE WHEN score >= 0.7 THEN 1 ELSE 0 END AS predicted")


#: Target weights of the mixing query: languages are set, sources and topics
#: are tempered from their own shares.
LANG_TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.12}


def op6_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import MixParams, mix

    return mix(_documents(spark, sf_dir), MixParams(targets={"lang": LANG_TARGETS}, tolerance=1e-10))


def op7_sstable_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import work_dir
    from .sstable import shard_digests, write_shards

    folder = f"{work_dir(spark)}/shards"
    return shard_digests(write_shards(_documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json")))


def learnable_languages(docs: DataFrame) -> DataFrame:
    """Documents that language identification may learn from."""
    return docs.where("crc32(cast(doc_id AS string)) % 4 <> 2 AND lang IS NOT NULL")


def op8_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train

    docs = _documents(spark, sf_dir)
    got = identify(docs, train(learnable_languages(docs)))
    return got.selectExpr("doc_id", "crc32(cast(doc_id AS string)) % 4 = 2 AS held_out", "lang_pred", "score", "n_spans", "switches")


def op9_aho_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .spm import encoding_digests

    return encoding_digests(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_documents(spark, sf_dir))


def op11_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_diff import main_text

    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .fim import fill_in_middle, restored

    got = fill_in_middle(_documents(spark, sf_dir))
    back = restored(F.col("output"), F.col("form"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import SpellingParams, spelling_groups

    return spelling_groups(_documents(spark, sf_dir), SpellingParams(slips=97))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_repetition": op1_suffix_repetition,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_snapshot_collapse": op3_snapshot_collapse,
    "op4_feistel_pseudonyms": op4_feistel_pseudonyms,
    "op5_lexicon_toxicity": op5_lexicon_toxicity,
    "op6_raked_mixture": op6_raked_mixture,
    "op7_sstable_token_ids": op7_sstable_token_ids,
    "op8_language_spans": op8_language_spans,
    "op9_aho_viterbi_pieces": op9_aho_viterbi_pieces,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_page_differencing": op11_page_differencing,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_spelling_groups": op13_spelling_groups,
}

def _windows_sql(size: int, name: str) -> str:
    """Distinct words that lie in windows of ``size`` words found twice or more."""
    window = "w[i:i + %d]" % (size - 1)
    return f"""
      {name}_at AS (SELECT rid, i, list_aggregate({window}, 'string_agg', ' ') AS g
                    FROM w, unnest(generate_series(1, len(w) - {size - 1})) AS s(i)),
      {name}_re AS (SELECT rid, i FROM {name}_at QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
      {name} AS (SELECT rid, count(DISTINCT i + o) AS n FROM {name}_re, unnest(generate_series(0, {size - 1})) AS s(o) GROUP BY rid)"""


def _rake_sql(rounds: int) -> str:
    """Raking by factors: a cell's weight is its tokens times one factor per
    level of each dimension; one common table expression per half step."""
    steps, held = [], {"source": None, "lang": None, "topic": None}
    weight = lambda but: " * ".join(["tokens", *[f"f_{d}" for d in held if d != but and held[d]]])
    joins = lambda but: " ".join(f"JOIN {held[d]} USING ({d})" for d in held if d != but and held[d])
    for k in range(rounds):
        for dim in ("source", "lang", "topic"):
            name = f"f{k}_{dim}"
            steps.append(f"{name} AS MATERIALIZED (SELECT {dim}, coalesce(any_value(to_{dim}) / nullif(sum({weight(dim)}), 0), 0) AS f_{dim} FROM cells {joins(dim)} JOIN {dim}_to USING ({dim}) GROUP BY {dim})")
            held[dim] = name
    return ",\n        ".join(steps) + f",\n        raked AS (SELECT source, lang, topic, tokens, {weight(None)} AS weight FROM cells {joins(None)})"


def _share_sql(dim: str, wish: str) -> str:
    return f"""{dim}_own AS (SELECT {dim}, sum(tokens) / sum(sum(tokens)) OVER () AS own FROM cells GROUP BY {dim}),
        {dim}_to AS (SELECT {dim}, ({wish}) / sum({wish}) OVER () AS to_{dim} FROM {dim}_own)"""


ORACLE_SQL: dict[str, str] = {
    "op3_snapshot_collapse": """
        WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
                   WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        c AS (SELECT conv_id, list(r || chr(1) || x ORDER BY turn) AS l, count(*) AS n FROM t GROUP BY conv_id),
        u AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n) AS n FROM c GROUP BY l),
        kept AS (SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.n > a.n AND b.l[1:a.n] = a.l))
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 256) - 1 AS part,
          any_value(n) AS n_turns, any_value(n_copies) AS n_copies,
          string_agg('<|' || replace(r, '<|', '< |') || '|>' || chr(10) || replace(x, '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY turn) AS text
        FROM t JOIN kept USING (conv_id) GROUP BY conv_id, turn // 256""",
    "op6_raked_mixture": f"""
        WITH d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, coalesce(text, '') AS t FROM documents),
        rows AS (
          SELECT doc_id, source, lang,
            CASE WHEN length(t) = 0 THEN 'prose' WHEN (length(t) - length(translate(t, '|', ''))) * 50 >= length(t) THEN 'table'
              WHEN (length(t) - length(translate(t, '0123456789', ''))) * 50 >= length(t) THEN 'data'
              WHEN (length(t) - length(translate(t, '#*$%&', ''))) * 50 >= length(t) THEN 'symbols'
              WHEN (length(t) - length(translate(t, chr(10), ''))) * 60 >= length(t) THEN 'list' ELSE 'prose' END AS topic,
            CASE WHEN t = '' THEN 0 ELSE length(t) - length(translate(t, ' ' || chr(10), '')) + 1 END AS tokens
          FROM d),
        cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM rows GROUP BY ALL),
        {_share_sql("source", "pow(own, 0.8)")},
        {_share_sql("lang", "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANG_TARGETS.items()) + " ELSE own END")},
        {_share_sql("topic", "pow(own, 0.8)")},
        {_rake_sql(60)},
        asked AS (SELECT source, lang, topic, 0.8 * sum(tokens) OVER () * weight / nullif(tokens, 0) AS p FROM raked),
        odds AS (SELECT source, lang, topic, round(coalesce(p / greatest(1.0, max(p) OVER ()), 0), 6) AS probability FROM asked)
        SELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, probability,
          CAST('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8) AS BIGINT) / 4294967296.0 < probability AS sampled
        FROM rows JOIN odds USING (source, lang, topic)""",
    "op1_suffix_repetition": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
        lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
        dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines
                WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
        {_windows_sql(5, 'r5')}, {_windows_sql(10, 'r10')}, {_windows_sql(51, 'r51')},
        m AS (
          SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
            CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
            CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
            CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r5.n, 0) AS BIGINT) AS n_repeat_words,
            CAST(coalesce(r10.n, 0) AS BIGINT) AS covered_words, r51.n IS NOT NULL AS long_repeat
          FROM w LEFT JOIN dup USING (rid) LEFT JOIN r5 USING (rid) LEFT JOIN r10 USING (rid) LEFT JOIN r51 USING (rid)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT base_failed AND 100 * covered_words <= 20 * n_words AND NOT long_repeat AS kept, covered_words
        FROM b""",
    "op2_minhash_near_dedup": """
        WITH RECURSIVE d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
          FROM documents),
        s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g FROM d, unnest(generate_series(1, greatest(1, len(w) - 4))) AS t(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        -- full sets: equal ones are one class, and classes are compared by their common shingles
        sets AS (SELECT doc_id, list(g ORDER BY g) AS l FROM s GROUP BY doc_id),
        c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY l) AS class FROM sets),
        cs AS (SELECT s.doc_id, g FROM s JOIN c USING (doc_id) WHERE c.class = c.doc_id),
        common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM cs a JOIN cs b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT u, v FROM common JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
        both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
        reach AS (SELECT doc_id AS u, doc_id AS root FROM c WHERE class = doc_id
          UNION SELECT b.v, r.root FROM reach r JOIN both_ways b ON b.u = r.u),
        roots AS (SELECT u, min(root) AS root FROM reach GROUP BY u)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(roots.root, d.doc_id) AS component_id, coalesce(roots.root, d.doc_id) = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN roots ON roots.u = c.class""",
    "op10_exact_dedup": """
        WITH t AS (
          SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
          FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM t GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
        FROM t JOIN g USING (t)""",
    "op12_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
        u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS l,
                list_transform([0, 1, 2, 3], lambda k: CAST('0x' || substr(h, 1 + 8 * k, 8) AS BIGINT)) AS h FROM d),
        c AS (SELECT *, CAST(len(l) AS BIGINT) AS n, least(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS a, greatest(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
                  WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
        x AS (SELECT *, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:n], '') AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
          CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
          sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
          sha256(t) AS restored_sha256
        FROM x""",
}
