import os

import pytest
from parity import DATA, assert_same, connect

from tickloom import queries_general, queries_tape, queries_vectors

MODULES = (queries_general, queries_tape, queries_vectors)
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}
ROOT = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_those_of_the_sql(spark, db, name):
    assert_same(QUERIES[name](spark, ROOT), db, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, ROOT).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
