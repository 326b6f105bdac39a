"""Queries without SQL: trained models and runs of the protocol."""

import pytest

from barspan.oracle.registry import SQL
from barspan.plans.tables import fresh_path, remove_tables, run_folder, written
from barspan.queries.registry import QUERIES

BARE = sorted(set(QUERIES) - set(SQL))


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    return {}


@pytest.mark.parametrize("name", BARE)
def test_runs_and_varies(spark, sf_dir, found, name):
    rows = found[name] = QUERIES[name](spark, sf_dir).toPandas()
    assert len(rows)
    if "status" in rows:
        assert set(rows["status"]) == {"ok"}, rows["error_msg"].tolist()
    if "pred" in rows:
        assert rows["pred"].notna().all() and rows["pred"].nunique() > 1


def test_tables_are_removed(spark):
    written(spark.range(3).toDF("x"), "three")
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    assert store.exists(folder)
    remove_tables(spark)
    assert not store.exists(folder) and fresh_path(spark, "x").startswith(run_folder(spark))
