"""The registered document queries and the pipeline on the smallest tables."""

import os

import pytest
from compare import connect, difference

from cellpulse.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLE_SQL[name]) is None


def test_queries_return_a_row_per_document(spark):
    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for name in ("op1_minhash_dedup", "op2_quality_classifier", "op3_sharding", "op4_language_id",
                 "op6_fingerprints", "op8_quality_rules", "op10_mixing"):
        assert QUERIES[name](spark, SF_DIR).count() == n, name


def test_stages_keep_the_columns_of_documents_and_take_effect(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if i < 3:
            assert docs.count() <= before
            before = docs.count()
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns) and docs.count() > 0


def test_the_whole_run_places_pieces(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SF_DIR).select("doc_id").distinct().count() > 0
