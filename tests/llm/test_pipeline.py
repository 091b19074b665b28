"""The registered queries, their oracles, and the stages of the pipeline."""

from __future__ import annotations

import glob

import duckdb
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_oracle import rows  # noqa: E402

from tapeweave.llm.common import cut  # noqa: E402
from tapeweave.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1].split('.')[0]} AS SELECT * FROM '{path}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_stages_keep_their_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = cut(stage(spark, docs, SF))
        if k < 4:
            assert docs.columns == columns, name
        after = docs.count()
        assert 0 < after <= before
        before = after
    assert docs.columns == ["doc_id", "n_tokens", "ids"] and docs.where("n_tokens <> size(ids)").count() == 0


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_stages_take_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "hello there my friend", None, None), (3, "hello there my friend", None, None), (None, "hello there my friend", "en", "b"), (4, "word " * 30_000, "en", "a")]
    docs = spark.createDataFrame([(i, t, lang, src, len(t or ""), 1.0, True, "x", 2, 3) for i, t, lang, src in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, class string, tokens int, n_tokens int").withColumn("meta.x", F.lit("y"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = cut(stage(spark, docs, SF))
        assert out.columns == docs.columns and out.count() <= 6, name
    ids = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert ids.count() == 6 and ids.where("doc_id = 1").first().n_tokens == 0
