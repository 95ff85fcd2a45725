"""Every core query against its SQL on the smallest tables."""

import pytest

from mnemosaic.plans import catalog
from oracle import connect, same


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, small, con, name):
    ours, theirs = same(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], small)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"vec_ann_recall"}))
def test_query_without_sql_runs(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


def test_entry_gives_rows(spark, small):
    assert catalog.entry(spark, small).count() > 0
