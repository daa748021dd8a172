import os

import pytest

import __spark_entry__ as registered
import corpus_pipeline
from oracle_check import compare, connect
from shelfmark.llm import queries
from tests_llm_odd import frame, rows

SMALL = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with null, empty, long and repeated texts and columns named like internal ones."""
    path = str(tmp_path_factory.mktemp("odd"))
    table = frame(spark, rows())
    table.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i == 8)) for i in range(20)],
                          "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_every_stage_bounds_the_batches_of_its_workers(spark, folder, name, stage):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        stage(spark, spark.read.parquet(f"{folder}/documents.parquet").limit(0), folder)
        assert spark.conf.get(key) == corpus_pipeline.BATCH_BYTES
    finally:
        spark.conf.set(key, before)


def test_stages_keep_columns_and_clean_documents(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        assert out.columns == docs.columns
        if name == "mixed_sources":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
        empty = stage(spark, docs.limit(0), folder)
        assert empty.columns == docs.columns and empty.count() == 0
        docs = out
    left = {r.doc_id for r in docs.collect()}
    assert left < ids and {40, 41, 42, 45} <= left and None in left


@given
def test_pipeline_packs_what_is_kept(spark):
    got = registered.queries()["pipeline"](spark, SMALL)
    assert got.columns[0] == "doc_id" and got.count() > 100


@given
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_small_folder_agrees_with_sql(spark, name):
    assert compare(spark, connect(SMALL), SMALL, name) == ""


@given
def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registered.queries() if n[:2] == "op")
    assert numbers == list(range(1, 14))
