"""Every query of the library against its SQL, and the others for rows."""

from __future__ import annotations

import pytest
from compare import difference, oracle

from spindrift.plans import catalogue


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, connection, name):
    assert difference(catalogue.QUERIES[name](spark, sf_dir), connection, catalogue.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_imports():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
