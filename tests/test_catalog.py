"""Every query of the catalogue against DuckDB, on the smallest tables."""

import pytest

from inkstone.queries.catalog import ORACLE, QUERIES
from tests.compare import duck, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = spark_rows(QUERIES[name](spark, SF))
    if name in ORACLE:
        assert found == duck_rows(con, ORACLE[name])
    else:
        assert found[0]


def test_entry_works():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
