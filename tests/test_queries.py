"""Every registered query with SQL returns the same rows as DuckDB."""

import pytest
from compare import differences, duck

from barspan.oracle.registry import SQL
from barspan.queries.registry import QUERIES

# Trained models without SQL are exercised in test_models.py.
CHECKED = sorted(SQL)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, con, sf_dir, name):
    problem = differences(QUERIES[name](spark, sf_dir).toPandas(), con.execute(SQL[name]).df())
    assert problem is None, problem


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["date", "n_rows", "ic"] and out.count() == 30
