"""Registration, and queries with SQL twins on the smallest tables."""

import os
import re
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_DIR = "/root/testdata/sf0.001"


def test_one_query_of_each_number():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14)) and "pipeline" in names


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
@pytest.mark.parametrize("number", [2, 3, 4, 7, 11, 13])
def test_query_equals_sql(spark, number):
    import __spark_entry__ as entry
    import oracle

    name = next(n for n in entry.queries() if n.startswith(f"op{number}_"))
    ok, message = oracle.compare(name, spark, oracle.duck(SF_DIR), SF_DIR, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message
