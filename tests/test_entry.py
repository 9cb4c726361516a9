import os

import pytest

import __spark_entry__ as entry
from mosswing import queries

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_flagship(spark):
    assert entry.entry(spark).count() == 10
