import os

import pytest

from sheaf.plans import catalog
from tests.util import DATA, assert_same, connection

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    assert_same(catalog.queries()[name](spark, DATA), con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() >= 0


def test_the_rest_works_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['sheaf.llm'] = None; import __spark_entry__ as e; assert 'q4_bm25_documents' in e.queries() and not any(k.startswith('p1_') for k in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
