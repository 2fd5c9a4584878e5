"""Every registered query with a SQL twin gives DuckDB's rows; the others run and give rows."""

import compare
import pytest

from logweir import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    rows, same, note = compare.compare(spark, con, name, catalog.queries()[name], catalog.oracles().get(name), SF)
    assert same is not False, note
    assert rows > 0 or name in catalog.oracles()
