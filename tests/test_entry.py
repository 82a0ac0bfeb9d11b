import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_names():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and {f"p{n}_found" for n in (1, 2, 3, 5)} <= set(q)


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
