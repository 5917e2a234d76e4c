"""Every query that has SQL gives the rows of its SQL; the rest give rows."""

import pytest
from shelfline.plans import catalog

from tests.conftest import SF
from tests.helpers import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, name):
    assert spark_rows(catalog.QUERIES[name](spark, SF)) == duck_rows(catalog.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
