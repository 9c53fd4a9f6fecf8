"""Every query of the library against its SQL."""

import pytest

from tests.conftest import SF
from tests.oracle import assert_equal
from wavelane.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    out = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert_equal(out, ORACLES[name], SF)
    else:
        assert out.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
