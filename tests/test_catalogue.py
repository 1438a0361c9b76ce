"""Every query of the primitives against its SQL, over whole tables."""

import pytest
from compare import differences

from tessel.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small_dir, name):
    got = catalogue.QUERIES[name](spark, small_dir)
    if name in catalogue.ORACLES:
        assert differences(got, catalogue.ORACLES[name], small_dir) == ""
    else:
        assert got.count() > 0
