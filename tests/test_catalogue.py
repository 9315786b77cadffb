"""Every registered query of the engine: equal to its SQL, or at least runnable."""

import pytest
from oracle import differences

from larkspur.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLE_SQL:
        _, more, less = differences(df, catalogue.ORACLE_SQL[name], SF)
        assert (more, less) == (0, 0)
    else:
        assert df.count() > 0
