"""Driver contract: entry runs on sf0.001, every query has a callable, oracle keys are a subset."""

import __spark_entry__ as E

from tests.conftest import SF


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["query_id", "rank", "doc_id", "score", "list_score", "description"]


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50
    assert all(callable(f) for f in q.values())


def test_some_queries_run_small(spark):
    qs = E.queries()
    for name in ("caption_parse", "description_parse", "query_parse", "moderate", "frame_plan", "debounce", "match_bm25", "tag_browse"):
        assert qs[name](spark, SF).count() > 0, name
