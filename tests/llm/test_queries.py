"""Each query against its SQL over whole tables."""

import pytest
from compare import differences

from tessel.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, small_dir, name):
    assert differences(queries.QUERIES[name](spark, small_dir), queries.ORACLES[name], small_dir) == ""


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
