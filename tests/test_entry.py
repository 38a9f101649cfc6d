from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_hits(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["tokenize_terms", "clean_pages", "corpus_stats", "fuzzy_expand", "bm25_exact", "search_ranked", "incremental_upsert", "upsert_stats", "status_transitions", "search_types", "search_hits", "suggest_merge", "snippet", "stem_terms", "stemmed_search"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
