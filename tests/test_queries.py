"""Every registered query against the SQL it must equal, on the smallest tables."""

import pytest

from souklens.plans.registry import all_queries, runner
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES = all_queries()


@pytest.fixture(scope="module")
def oracle():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, oracle, name):
    q = QUERIES[name]
    df = runner(q)(spark, SF)
    if q.oracle is None:
        assert df.collect()
    else:
        diff, _ = difference(df, oracle, q.oracle)
        assert diff is None, diff
