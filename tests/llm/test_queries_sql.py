"""Each query with an SQL counterpart against it, and the shape of the contract."""

import pytest

from isotrend.llm.queries import ORACLES, QUERIES
from oracle import compare, connect


@pytest.fixture(scope="module")
def con(medium):
    return connect(medium)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, medium, name):
    rows, problem = compare(spark, con, medium, QUERIES[name], ORACLES[name])
    assert problem is None
    assert rows > 0


def test_registered():
    import __spark_entry__ as contract

    names = contract.queries().keys()
    assert [sum(name.startswith(f"op{n}_") for name in names) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in names
