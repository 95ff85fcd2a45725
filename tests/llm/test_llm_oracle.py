"""The queries of the llm operators against their SQL on the smallest tables; those without SQL have to run."""

import pytest

from mnemosaic.llm import queries as llm
from oracle import connect, same


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, small, con, name):
    ours, theirs = same(spark, con, llm.queries()[name], llm.oracle_sql()[name], small)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_query_without_sql_runs(spark, small, name):
    assert llm.queries()[name](spark, small).count() > 0
