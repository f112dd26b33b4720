"""Every query with a DuckDB form gives the same values, and the others give rows."""

import pytest
from compare import connect, difference

from litradar.catalog import ORACLE, QUERIES, ROWS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_values(spark, duck, name):
    assert difference(spark, duck, name, SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_query_names_its_rows():
    assert set(ROWS) == set(QUERIES)
    assert set(ORACLE) <= set(QUERIES)
