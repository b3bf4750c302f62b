"""Every registered query against its SQL, cell by cell."""

import pytest

from tabaudit.registry.catalog import REGISTRY
from tests.compare import connect, difference
from tests.conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = connect(DATA)
    yield con
    con.close()


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_matches_sql(spark, duck, name):
    assert difference(spark, duck, name, DATA) is None


def test_every_query_has_sql():
    assert [name for name, q in REGISTRY.items() if not q.oracle] == []


def test_entry_returns_one_row(spark):
    import __spark_entry__ as entry_module

    df = entry_module.entry(spark)
    assert df.columns == ["segment_total", "segment_rows", "share"]
    assert df.count() == 1
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
