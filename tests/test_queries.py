"""A sample of registered queries against their SQL twins on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "bm25_topk", "dense_topk", "rrf_fusion", "hard_chunks", "parent_child", "evidence_gate", "gold_passages", "citation_validation",
    "acl_allowed_sources", "index_manifest_digest", "content_dedupe", "dispatchable_jobs", "rate_limit_fixed_window", "nearest_percentiles", "graph_bfs_2hop",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return oracle.duck(SF_DIR)


def test_every_twin_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 100


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    import __spark_entry__ as entry

    ok, message = oracle.compare(name, spark, duck, SF_DIR, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def test_flagship_returns_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
