"""What steps leave on disk, and that their bounded forms give the same rows."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspan.operators import extra_trees, models, protocol
from barspan.operators.extra_trees import Forest, draw_cuts, drawn_rows, fit_forest
from barspan.plans import catalogue, tables
from barspan.plans.catalogue import CATALOGUE, build_features, written_features
from barspan.sources.bars import panel_from_events
from barspan.sources.store import FeatureStore

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def panel(spark, small_dir):
    return panel_from_events(spark, small_dir)


def shuffled(spark):
    """Shuffle files on the executors' disks."""
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {local.apply(i).getName() for i in range(local.size()) if local.apply(i).getName().startswith("shuffle_")}


def gone(spark, before):
    """Whether all newer shuffle files are deleted, which Spark does in the background."""
    for _ in range(100):
        if shuffled(spark) <= before:
            return True
        time.sleep(0.1)
    return False


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame({"a": rng.normal(0, 1, n), "b": rng.integers(0, 4, n) * 1.0, "c": rng.exponential(5.0, n), "d": np.where(np.arange(n) < 40, 1.0, 0.0)})
    pdf["n"], pdf["y"] = np.arange(n), np.where(pdf["a"] > 0.2, 1.0, -1.0) + 0.3 * pdf["b"] + rng.normal(0, 0.4, n)
    return pdf


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffled(spark)
    table = tables.written(spark.range(2000).repartition(5, "id"), "numbers")
    assert gone(spark, before) and table.where("id >= 0").collect()
    assert spark.conf.get(tables.CLEANUP) == "false"


def test_stages_and_forests_leave_no_shuffle_files(spark, panel, tmp_path, drawn):
    before = shuffled(spark)
    FeatureStore(panel, str(tmp_path / "s")).write_stage("base", panel.df.select("date").distinct())
    assert gone(spark, before)
    fit_forest(spark.createDataFrame(drawn), COLUMNS, "y", Forest(trees=3, depth=6, least_rows=5), ["n"])
    assert gone(spark, before)
    folder = spark._jvm.org.apache.hadoop.fs.Path(tables.run_folder(spark))
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    assert not any(n.startswith("forest-") for n in names)


def test_rows_of_a_node_draw_the_same_cuts(drawn):
    x = np.ascontiguousarray(drawn[COLUMNS].to_numpy(np.float32).T)
    some = np.arange(100, 300)  # d is constant there
    for share in (0.3, 0.6, 1.0):
        for tree, path in ((0, 1), (3, 6), (7, 4097)):
            p = Forest(column_share=share)
            found, cells = drawn_rows(p, tree, path, x, some)
            assert found == draw_cuts(p, tree, path, x[:, some].min(axis=1), x[:, some].max(axis=1))
            assert (cells == x[[k for k, _ in found]][:, some]).all()


@pytest.mark.parametrize("share", [None, 0.7])
def test_grown_in_tasks_as_by_passes(spark, drawn, share, monkeypatch):
    p = Forest(trees=6, depth=7, least_rows=6, column_share=0.6, sample_share=share)
    made = lambda fit: [sorted((c, cut, round(g, 6)) for c, cut, g in zip(t.column, t.threshold, t.gain) if c >= 0) for t in fit.trees]
    table, passes = spark.createDataFrame(drawn).repartition(3), []
    grow = extra_trees._grow_level
    monkeypatch.setattr(extra_trees, "_grow_level", lambda *a: passes.append(len(a[-1])) or grow(*a))
    by_passes = fit_forest(table, COLUMNS, "y", p, ["n"])
    assert len(passes) >= 5
    monkeypatch.setattr(extra_trees, "LEVEL_CELLS", 30)
    monkeypatch.setattr(extra_trees, "SENT_BYTES", 40_000)  # several parts
    passes.clear()
    in_tasks = fit_forest(table, COLUMNS, "y", p, ["n"])
    assert len(passes) <= 2 and made(in_tasks) == made(by_passes)
    score = lambda fit: [r["pred"] for r in fit.predict(table).orderBy("n").collect()]
    np.testing.assert_allclose(score(in_tasks), score(by_passes), rtol=1e-9, atol=1e-12)


def test_features_written_by_steps(spark, panel, monkeypatch):
    groups = ["lag", "regime"]
    whole = rows_of(build_features(panel, groups))
    monkeypatch.setattr(catalogue, "STEP_ROWS", panel.layout.total_rows * 2 // 3)
    assert len(catalogue.date_steps(panel)) == 2
    assert rows_of(written_features(panel, groups)) == whole
    floats = written_features(panel, groups, exact=protocol.REGIME_META)
    kinds = dict(floats.dtypes)
    assert kinds["regime_score"] == kinds["fret12"] == "double" and kinds["obi0_lag_3"] == "float" and floats.columns == build_features(panel, groups).columns


def test_stages_written_by_steps(spark, panel, tmp_path, monkeypatch):
    days = panel.df.select("date").distinct().where("date <= 20240121")
    whole, parts = (FeatureStore(panel, str(tmp_path / n)) for n in ("whole", "parts"))
    whole.write_stage("base", days)
    monkeypatch.setattr(catalogue, "STEP_ROWS", panel.layout.total_rows // 3)
    steps = catalogue.date_steps(panel, days)
    assert len(steps) > 1 and [d for dates, _ in steps for d in dates] == sorted(r["date"] for r in days.collect())
    parts.write_stage("base", days)
    assert rows_of(parts.read_stage("base")) == rows_of(whole.read_stage("base")) != []


def test_stored_training_rows_are_not_kept_again(spark, panel, monkeypatch):
    """Rows of a written table are read again from there: a second copy of them would lie on the executors' disks."""
    kept = []
    persist = type(panel.df).persist
    monkeypatch.setattr(type(panel.df), "persist", lambda self, *a: kept.append(1) or persist(self, *a))
    columns = CATALOGUE.columns(["legacy"])
    rows = written_features(panel, ["legacy"])
    stored = models.fit_model(panel, rows.where("date <= 20240120"), columns, "ridge")
    assert not kept
    plain = models.fit_model(panel, build_features(panel, ["legacy"]).where("date <= 20240120"), columns, "ridge")
    assert kept and np.allclose(stored.coef, plain.coef, rtol=1e-9, atol=1e-15)


# -- boosting ------------------------------------------------------------------------


def test_one_task_boosts_as_passes_do(spark, drawn, monkeypatch):
    from barspan.operators import boosting

    params = boosting.Boosting(rounds=9, rate=0.3, leaves=6, depth=4, least_rows=20, column_share=0.75, l1=0.0, l2=1.0)
    table, passes, count = spark.createDataFrame(drawn).repartition(3), [], boosting.node_histograms
    monkeypatch.setattr(boosting, "node_histograms", lambda *a: passes.append(a[-1]) or count(*a))
    alone = boosting.boost(table, COLUMNS, "y", params)
    assert not passes
    monkeypatch.setattr(boosting, "LOCAL_CELLS", 0)
    monkeypatch.setattr(boosting, "COLUMNS_TOGETHER", 3)
    together = boosting.boost(table, COLUMNS, "y", params)
    assert len(passes) > 9 and {len(columns) for columns in passes} == {3}  # drawn columns alone
    assert [t.column for t in alone.trees] == [t.column for t in together.trees] and len(alone.trees) == 9
    score = lambda fit: [r["pred"] for r in fit.predict(table).orderBy("n").collect()]
    np.testing.assert_allclose(score(alone), score(together), rtol=1e-9, atol=1e-12)
    folder = spark._jvm.org.apache.hadoop.fs.Path(tables.run_folder(spark))
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    assert not any(n.startswith("boosting-") for n in names)


def test_members_query_fits_the_default_members(panel, monkeypatch):
    from barspan.operators.specs import MEMBERS
    from barspan.queries import model_queries

    seen = {}

    def engine(p, members, train, val, **options):
        seen.update(members=members, **options)
        return p.df.withColumn("pred", F.lit(0.0))

    monkeypatch.setattr(model_queries.protocol, "run_engine", engine)
    model_queries.h12_members(panel)
    assert list(seen["members"]) == MEMBERS and seen["params"] == {"M_lgbm_d4": {"l1": 1e-4}}
