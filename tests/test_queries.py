"""Every registered query of the core over the smallest tables: against its SQL, or for rows."""

import pytest

from burstline.plans import catalog

from .compare import difference


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, folder, name):
    assert difference(spark, catalog.QUERIES[name], catalog.SQL[name], folder) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, folder, name):
    df = catalog.QUERIES[name](spark, folder)
    assert df.columns
    df.collect()
