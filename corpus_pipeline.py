"""From raw documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame; ``run``
writes every stage's rows to the shared folder and hands them, reread, to the
next.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeweave.llm import exact_dedup, langid, mixing, neardup, spm
from tapeweave.llm.common import cut
from tapeweave.llm.queries import LANG_TARGETS, learnable_languages


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents written in a language that was learned.

    ``lang`` stays as given.  Texts that are null, empty or without letters go,
    and so do those of which no language has 40 % of the letters; letters of
    scripts that were not learned count for none.  That language's words must be
    about as likely as in labelled documents: other languages and junk go.
    Null identifiers and languages are nothing special, repeated rows stay or go
    together, an empty table gives an empty one.
    """
    model = langid.train(learnable_languages(docs), floors=True)
    return langid.accepted(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, the largest ``doc_id``.

    Null text is an empty text; a null identifier loses to any other.  Of rows
    with one identifier and equal text the one with the least hash of all its
    columns stays.  An empty table gives an empty one.
    """
    return exact_dedup.deduplicated(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, the smallest ``doc_id``.

    Links from a Jaccard similarity of 0.80 on; 48 bands of 6 miss a pair at
    0.80 with probability ``(1 - 0.8 ** 6) ** 48`` = 5e-7.  Null, empty or blank
    texts are linked with nothing and stay; rows without identifier go if their
    group has a named row; repeated rows share their fate; an empty table gives
    an empty one.
    """
    return neardup.without_near_duplicates(docs, neardup.NearDupParams(percent=80, bands=48))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by probabilities raked to the target marginals.

    Languages have targets; sources and topics keep their shares, as no rare one
    of them should set how much can be sampled of all (see ``MixParams``).
    Null sources and languages are the level ``unknown``; null and empty texts
    hold no tokens and take their cell's probability; rows that repeat an
    identifier share its draw, as all null identifiers do; an empty table gives
    an empty one.
    """
    return mixing.sampled(docs, mixing.MixParams(targets={"lang": LANG_TARGETS}, temper=1.0))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: ``doc_id, n_tokens, ids``.  Null and empty
    texts have none, repeated rows are encoded each, null identifiers pass
    through, an empty table gives an empty one."""
    import public_tokenizers

    return spm.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Viterbi labelling, sketches and piece encoding are beyond SQL; tests compare
#: the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
