import os

import pytest
from parity import DATA, assert_same, connect

from tickloom.llm.queries import QUERIES, SQL

ROOT = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_those_of_the_sql(spark, name):
    assert_same(QUERIES[name](spark, ROOT), connect(ROOT), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, ROOT).count() > 0
