"""Second moments per date against fits and scores on the rows themselves."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspan.operators import gram, labels, models
from barspan.operators.specs import Spec

COLUMNS = ["a", "b", "c", "steady"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({"date": rng.integers(1, 7, n), "a": rng.normal(1e6, 3, n), "b": rng.normal(0, 1e-7, n), "c": rng.normal(size=n), "steady": 0.1})
    pdf["fret12"] = 0.3 * pdf["c"] + 2e6 * pdf["b"] + rng.normal(size=n)
    pdf.loc[::50, "c"] = None
    return pdf


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows).withColumn("date", F.col("date").cast("long")).repartition(7)


def plain(rows):
    return rows[COLUMNS].fillna(0.0).to_numpy(), rows["fret12"].to_numpy()


def test_blocks_equal_the_rows(table, rows):
    blocks = gram.date_blocks(table, COLUMNS)
    for r in blocks.collect():
        x, y = plain(rows[rows["date"] == r["date"]])
        z = np.column_stack([x, y])
        assert r["n"] == len(z) and r["low"] == z.min(axis=0).tolist() and r["high"] == z.max(axis=0).tolist()
        np.testing.assert_allclose(r["mean"], z.mean(axis=0), rtol=1e-9)
        np.testing.assert_allclose(np.reshape(r["scatter"], (5, 5)), (z - z.mean(axis=0)).T @ (z - z.mean(axis=0)), rtol=1e-6, atol=1e-12)
    assert blocks.count() == 6


def test_ridge_and_scores_equal_the_rows(table, rows):
    blocks, train, val = gram.date_blocks(table, COLUMNS), [1, 2, 3, 4], [5, 6]
    fit = gram.fit_dates(blocks, COLUMNS, Spec("x"), train, 2.0)
    x, y = plain(rows[rows["date"].isin(train)])
    scale = np.where(x.max(axis=0) > x.min(axis=0), x.std(axis=0), 1.0)
    z = np.where(x.max(axis=0) > x.min(axis=0), (x - x.mean(axis=0)) / scale, 0.0)
    b = np.linalg.solve(z.T @ z + 2.0 * np.eye(4), z.T @ (y - y.mean()))
    np.testing.assert_allclose(fit.scaled_coef, b, rtol=1e-6, atol=1e-9)
    assert fit.scaled_coef[3] == 0.0
    x, y = plain(rows[rows["date"].isin(val)])
    pred = fit.intercept + x @ fit.coef
    found = gram.score_dates(blocks, COLUMNS, fit, val)
    assert found["corr"] == pytest.approx(np.corrcoef(pred, y)[0, 1], rel=1e-6)
    assert found["mse"] == pytest.approx(((pred - y) ** 2).mean(), rel=1e-6)
    assert found["r2"] == pytest.approx(1 - ((pred - y) ** 2).sum() / (y.var() * len(y) + 1e-8), rel=1e-6)


def test_elastic_net_from_a_block(table, rows):
    blocks = gram.date_blocks(table, COLUMNS)
    spec = Spec("x", model="elasticnet", params={"alpha": 1e-2, "l1_ratio": 0.5})
    fit = gram.fit_dates(blocks, COLUMNS, spec, [1, 2, 3])
    whole = models.elastic_net(models.moments(table.fillna(0.0).where("date <= 3"), COLUMNS, ["fret12"]), 1e-2, 0.5)
    np.testing.assert_allclose(fit.scaled_coef, whole.scaled_coef, rtol=1e-6, atol=1e-9)


def test_constant_sides_score_zero(spark):
    table = spark.createDataFrame([(1, 0.1, 2.0)] * 9 + [(2, 0.1, 1.0), (2, 0.1, 3.0)], "date long, a double, fret12 double")
    blocks = gram.date_blocks(table, ["a"])
    fit = gram.fit_dates(blocks, ["a"], Spec("x"), [1, 2])
    assert fit.coef.tolist() == [0.0]
    assert [gram.score_dates(blocks, ["a"], fit, [d])["corr"] for d in (1, 2)] == [0.0, 0.0]


def test_merged_keeps_digits():
    rng = np.random.default_rng(1)
    x = rng.normal(1e9, 1e-2, (1000, 2))
    parts = gram.merged(gram.Block.of(p) for p in np.array_split(x, 13))
    np.testing.assert_allclose(np.diag(parts.scatter), np.diag(gram.Block.of(x).scatter), rtol=1e-3)


@pytest.mark.parametrize("kind", ["noise", "ties", "tiny"])
def test_fold_bounds_are_exact(spark, kind):
    """Quantiles of overlapping sets of dates, from counts per date."""
    rng = np.random.default_rng(5)
    values = {"noise": rng.normal(size=900), "ties": rng.integers(-2, 3, 900) * 0.5, "tiny": rng.normal(size=900) * 1e-9}[kind]
    pdf = pd.DataFrame({"date": rng.integers(0, 9, 900), "fret12": values})
    table = spark.createDataFrame(pdf).withColumn("date", F.col("date").cast("long"))
    table = table.unionByName(spark.createDataFrame([(0, None)], "date long, fret12 double"))
    folds = [(f, d) for f in range(6) for d in range(f, f + 4)]
    days = spark.createDataFrame(folds, "fold_id long, date long")
    wanted = {"low.bound": 0.01, "mid": 0.5, "top": 1.0, "bottom": 0.0, "high": 0.977}
    for r in labels.fold_bounds(table, days, ["fold_id"], wanted).collect():
        own = pdf[pdf["date"].between(r["fold_id"], r["fold_id"] + 3)]["fret12"]
        assert [r[n] for n in wanted] == pytest.approx([np.quantile(own, q) for q in wanted.values()], rel=1e-12, abs=1e-18)


def test_bars_are_read_once_for_all_folds(spark, table):
    """The plan of the bounds scans the counts, never the bars per fold."""
    days = spark.createDataFrame([(f, d) for f in range(3) for d in range(f, f + 4)], "fold_id long, date long")
    plan = labels.fold_bounds(table, days, ["fold_id"], {"low": 0.01})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("date_counts") and "fret12" not in plan
