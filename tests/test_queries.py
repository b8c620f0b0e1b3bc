import pytest

from __spark_entry__ import entry
from millrace.oracle import oracle_sql
from millrace.queries import queries
from compare import difference, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, connection, name):
    assert difference(queries()[name](spark, SF_DIR), connection, oracle_sql()[name]) is None


def test_entry(spark):
    row = entry(spark).first()
    assert row.all_rows == row.curated_rows + row.quarantine_rows > 0
