"""Every query of the core against its SQL on the smallest tables."""

import pytest
import verify

from tilewright import queries as core


@pytest.fixture(scope="module")
def con(request):
    import os

    from conftest import SMALL

    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return verify.connect(SMALL)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_same_rows_as_sql(spark, small, con, name):
    text, ok = verify.compare(spark, con, name, small)
    assert ok, text


#: Queries whose rows SQL can't give: they rest on an optimal matching. Tested against brute force in test_upkeep.
WITHOUT_SQL = {"p7_renames"}


def test_every_query_has_sql():
    assert set(core.queries()) == set(core.oracle_sql()) | WITHOUT_SQL
