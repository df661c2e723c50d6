import os

import pytest

from sheaf.llm import oracles, queries
from tests.util import DATA, assert_same, connection

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert_same(queries.queries()[name](spark, DATA), connection(), oracles.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_and_gives_distinct_rows(spark, name):
    df = queries.queries()[name](spark, DATA)
    rows = list(map(str, df.collect()))
    assert len(rows) == len(set(rows))
