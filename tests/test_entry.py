import os

import pytest

import __spark_entry__ as registered
from oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")


def test_every_sql_belongs_to_a_query():
    queries, sql = registered.queries(), registered.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


@given
def test_entry_runs(spark):
    df = registered.entry(spark)
    assert df.columns == ["query_id", "rank", "path", "score", "term_hits", "matched"]
    assert df.count() > 0


@given
@pytest.mark.parametrize("name", [
    "search_hybrid_gradient", "event_grouping", "dedup_exact", "catalog_provenance", "palette",
    "library_page", "library_neighbours", "vector_topk", "name_resolution", "label_status",
    "index_fingerprint", "multiset_delta", "cosine_pairs", "capture_times", "keeper_text_sizes",
    "source_csv", "source_index", "source_baseline", "source_files", "event_largest",
    "term_matches", "filter_pool", "search_trimmed", "event_roster", "dbscan",
    "event_understanding", "query_understanding", "enrich_chunks_ledger", "enrich_chunks_outputs",
    "source_optional"])
def test_small_folder_agrees_with_sql(spark, name):
    assert compare(spark, connect(SMALL), SMALL, name) == ""
