"""The entry module's contract."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"


def test_names_and_sql():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 60
    assert all(callable(q) for q in queries.values())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
