"""Goldens of folds, metrics, blends, verdicts, store, search and models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspan.operators import blend, features, folds, leaderboard, metrics, models, protocol, scans, search, sequences, specs
from barspan.operators.specs import Spec
from barspan.plans import catalogue as catalogue_module
from barspan.plans.catalogue import CATALOGUE, Catalogue, Stage
from barspan.plans.layout import Layout, Limits
from barspan.sources.bars import Panel, panel_from_events
from barspan.sources.calendar import calendar_table
from barspan.sources.predictions import append_oof, load_member
from barspan.sources.journal import BrokenOff, Journal
from barspan.sources.store import FeatureStore, Staleness, save_run

KEYS = ["date", "symbol", "bar"]


@pytest.fixture(scope="module")
def panel(spark, small_dir):
    return panel_from_events(spark, small_dir)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def plain_panel(df):
    return Panel(df, Layout(1000, 1000, 1000, 1000), Limits())


# -- folds -------------------------------------------------------------------------


def calendar(spark, n):
    return calendar_table(spark.range(1, n + 1).select(F.col("id").alias("day")))


def test_profiles_on_a_real_calendar_length(spark):
    c = calendar(spark, 104)
    counts = [folds.fold_table(c, p).count() for p in folds.PROFILES]
    assert counts == [len(range(9, 103, 5)), len(range(21, 100, 5)), len(range(41, 100, 10)), len(range(40, 99, 5))]
    first = folds.fold_table(c, folds.PROFILES[3]).orderBy("fold_id").first()
    assert (first["train_start"], first["train_end"], first["embargo_start"], first["val_start"], first["val_end"]) == (1, 40, 41, 42, 46)
    assert sum(folds.PROFILE_WEIGHTS.values()) == pytest.approx(1.0)


def test_recent_folds_hug_the_end_and_are_causal(spark):
    profile = folds.Profile("recent", val_days=5, step=5, mode="expanding", min_train_days=40)
    days = folds.four_segment_folds(calendar(spark, 80), profile, "recent", 3)
    folds.assert_causal(days)
    scoring = days.where("segment = 'scoring'").groupBy("fold_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    assert [tuple(r) for r in scoring.orderBy("fold_id").collect()] == [(0, 66, 70), (1, 71, 75), (2, 76, 80)]
    bad = days.withColumn("segment", F.when(F.col("segment") == "scoring", "train_core").otherwise("scoring"))
    with pytest.raises(AssertionError):
        folds.assert_causal(bad)


def test_fold_fallback_and_errors(spark):
    row = folds.simple_folds(calendar(spark, 7), 40, 10, 10).collect()
    assert len(row) == 1 and row[0]["val_start"] == 6 and row[0]["n_train_days"] == 5
    assert folds.simple_folds(calendar(spark, 2), 40, 10, 10).count() == 0
    with pytest.raises(ValueError):
        folds.fold_table(calendar(spark, 5), folds.Profile("x", 1, 1, mode="odd"))


# -- blends ------------------------------------------------------------------------


def test_blend_goldens(spark):
    df = frame(spark, [(1, 1, 1, 0.0, 1.0, 2.0), (1, 2, 1, 0.0, 2.0, 4.0), (2, 1, 1, 0.0, 10.0, 30.0), (2, 2, 1, 0.0, 20.0, 10.0)],
               "date int, symbol int, bar int, label double, a double, b double")
    raw = df.withColumn("pred", blend.mean_of_members(["a", "b"])).orderBy(*KEYS)
    assert [r["pred"] for r in raw.collect()] == [1.5, 3.0, 20.0, 15.0]
    z = blend.daily_zscore_mean(df, ["a", "b"]).orderBy(*KEYS)
    assert [r["pred"] for r in z.collect()] == pytest.approx([-1.0, 1.0, 0.0, 0.0])
    with pytest.raises(ValueError):
        blend.weighted_blend(df, {"a": 1.0}, "odd")


def test_fusion_goldens(spark):
    trad = frame(spark, [(1, s, 1, p) for s, p in enumerate([1.0, 2.0, 3.0, 4.0])], "date int, symbol int, bar int, pred double")
    dl = frame(spark, [(1, 2, 1, 30.0), (1, 0, 1, 10.0)], "date int, symbol int, bar int, pred_dl double")
    assert [r["fused"] for r in blend.fuse(trad, dl).orderBy("symbol").collect()] == [5.5, 2.0, 16.5, 4.0]
    assert [r["fused"] for r in blend.fuse(trad, dl.limit(0)).orderBy("symbol").collect()] == [1.0, 2.0, 3.0, 4.0]


def test_flat_members(spark):
    rows = frame(spark, [(0, 1, i, 1, float(i), 5.0) for i in range(4)], "fold_id int, date int, symbol int, bar int, label double, p double")
    lens = metrics.lenses(rows, "p").first()
    assert lens["pooled_corr"] == 0.0 and lens["daily_ic_ir"] is None and lens["n_rows"] == 4
    assert {r["p_z"] for r in blend.global_zscores(rows, ["p"]).collect()} == {0.0}


# -- metrics -----------------------------------------------------------------------


def test_metric_identities(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=400)
    p = 0.3 * y + rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "date": np.repeat([1, 2], 200), "pred": p, "label": y}))
    row = metrics.bundle(df, []).first()
    assert row["corr"] == pytest.approx(np.corrcoef(p, y)[0, 1])
    assert row["r2"] == pytest.approx(1 - ((p - y) ** 2).sum() / (y.var() * 400 + 1e-8))
    daily = [np.corrcoef(p[i : i + 200], y[i : i + 200])[0, 1] for i in (0, 200)]
    assert row["daily_corr_mean"] == pytest.approx(np.mean(daily)) and row["daily_corr_std"] == pytest.approx(np.std(daily))
    perfect = df.withColumn("pred", F.col("label")).agg(*metrics.pooled()).first()
    assert perfect["corr"] == pytest.approx(1.0) and perfect["mse"] == 0.0
    fitted = models.ols_rescale(df, ["g"])
    scored = models.apply_rescale(df, fitted, ["g"]).agg(*metrics.pooled()).first()
    assert scored["r2"] == pytest.approx(row["corr"] ** 2, rel=1e-6)
    one = df.limit(1).withColumn("g", F.lit(3))
    assert tuple(models.ols_rescale(one, ["g"]).select("a", "b").first()) == (1.0, 0.0)


def test_fold_metrics_equal_repeated_rows(spark, panel):
    rows = panel.df.select(*KEYS, F.lit("x").alias("experiment_id"), F.col("fret12").alias("label"), (F.col("midpx") / F.col("open") - 1).alias("pred"))
    rows = rows.withColumn("label", F.col("pred") * F.col("symbol") + F.col("bar") / 1e9)
    c = calendar_table(panel.df.select(F.col("date").alias("day")))
    days = folds.fold_days(c, [folds.Profile("p", 3, 3, mode="expanding", min_train_days=12)])
    got = protocol.fold_metrics(rows, days).orderBy("fold_id").toPandas()
    direct = rows.join(days, "date").where("segment = 'val'").groupBy("fold_id").agg(*metrics.pooled()).orderBy("fold_id").toPandas()
    for m in ("corr", "mse", "r2"):
        assert np.allclose(got[f"val_{m}"], direct[m], rtol=1e-9)


# -- verdicts ----------------------------------------------------------------------

BASE = dict(corr=0.050, stab=0.040, ic=0.020, short=0.050, long=0.050, expanding=0.050, low=0.020)
GOOD = dict(corr=0.056, stab=0.045, ic=0.022, short=0.056, long=0.052, expanding=0.056, low=0.022)


def judged(spark, **changes):
    def row(name, v):
        return (name, v["corr"], v["stab"], v["ic"], v["short"], v["long"], v["expanding"], v["low"], v.get("short_low", v["low"]))

    schema = (
        "experiment_id string, protocol_corr_mean double, protocol_stability_score double, protocol_daily_ic_mean double, "
        "short_corr_mean double, long_corr_mean double, expanding_corr_mean double, low double, short_corr_min double"
    )
    board = spark.createDataFrame([row("base", BASE), row("cand", GOOD | changes)], schema)
    board = board.withColumns({"long_corr_min": F.col("low"), "expanding_corr_min": F.col("low")})
    base = board.where("experiment_id = 'base'").agg(F.first(F.struct("*")).alias("b")).scalar()
    return board.withColumn("_b", base).where("experiment_id = 'cand'").select(leaderboard.verdict()).first()[0]


@pytest.mark.parametrize(
    "changes, expected",
    [
        ({}, "promote"),
        ({"corr": 0.051}, "reject"),
        ({"corr": 0.054}, "review"),
        ({"expanding": None}, "review"),
        ({"expanding": -0.01}, "review"),
        ({"short": 0.049}, "review"),
        ({"long": 0.040}, "review"),
        ({"ic": 0.019}, "review"),
        ({"stab": 0.039}, "review"),
        ({"short_low": -0.02}, "review"),
        ({"short_low": -0.001}, "review"),
        ({"corr": None}, "unknown"),
    ],
)
def test_verdict(spark, changes, expected):
    assert judged(spark, **changes) == expected


# -- store -------------------------------------------------------------------------


def _one(panel, df):
    return df.withColumn("one", F.col("midpx") + F.lit(1.0))


def _two(panel, df):
    return df.withColumn("two", F.col("one") * F.lit(2.0))


def _two_changed(panel, df):
    return df.withColumn("two", F.col("one") * F.lit(3.0))


def small_catalogue(two=_two):
    return Catalogue(
        [
            Stage("one", _one, ["one"], groups={"g": ["one"]}),
            Stage("two", two, ["two"], ("one",), groups={"g": ["two"]}),
        ]
    )


def test_store_builds_only_what_is_dirty(spark, panel, tmp_path):
    days = sorted(r["date"] for r in panel.df.select("date").distinct().collect())
    store = FeatureStore(panel, str(tmp_path / "s"), small_catalogue())
    assert {r.code for r in store.dirty().values()} <= {"version", "unrecorded"}
    assert set(store.build(days[:5])) == {"one", "two"}
    assert store.build(days[:5]) == {}
    assert store.dirty(days[:7]) == {"one": Staleness("days", detail=2), "two": Staleness("days", detail=2)}
    store.build(days[:7])
    assert store.built_days("two").count() == 7
    changed = FeatureStore(panel, str(tmp_path / "s"), small_catalogue(_two_changed))
    assert list(changed.dirty(days[:7])) == ["two"] and changed.dirty(days[:7])["two"].code == "code"
    assert store.dirty(days[:7], force=True, stages=["one"]) == {"one": Staleness("forced"), "two": Staleness("forced")}
    newer = FeatureStore(panel, str(tmp_path / "s"), small_catalogue(), version="2")
    assert set(newer.dirty(days[:7])) == {"one", "two"}
    with pytest.raises(KeyError):
        store.dirty(stages=["odd"])
    loaded = store.load(days[:7], ["g"])
    assert dict(loaded.dtypes)["two"] == "float"
    assert loaded.where("abs(two - 2 * one) > 1e-3").count() == 0
    assert dict(store.load(days[:2], ["g"], "float64").dtypes)["two"] == "double"
    with pytest.raises(ValueError):
        store.load(days[:2], ["g"], "int8")
    with pytest.raises(ValueError):
        store.check_alignment("one")
    assert {r["state"] for r in store.status(days[:7]).collect()} == {"ok"}


def test_version_is_judged_per_stage(spark, panel, tmp_path):
    """A partial build after a change of version converges."""
    days = sorted(r["date"] for r in panel.df.select("date").distinct().collect())[:2]
    root = str(tmp_path / "s")
    FeatureStore(panel, root, small_catalogue()).build(days)
    newer = FeatureStore(panel, root, small_catalogue(), version="2")
    assert newer.dirty(days, stages=["two"]) == {"two": Staleness("version", "1", "2")}
    newer.build(days, stages=["two"])
    assert newer.dirty(days, stages=["two"]) == {}
    assert set(newer.dirty(days)) == {"one", "two"}  # "one" is still old, and "two" depends on it
    newer.build(days)
    assert newer.dirty(days) == {}


def test_hash_sees_helpers_and_constants(monkeypatch):
    before = {s: CATALOGUE.code_hash(s) for s in CATALOGUE.stages}
    assert before == {s: CATALOGUE.code_hash(s) for s in CATALOGUE.stages}
    monkeypatch.setattr(features, "FLOW_WINDOWS", (6, 7))
    changed = {s for s in before if CATALOGUE.code_hash(s) != before[s]}
    assert "ofi" in changed and "base" not in changed
    monkeypatch.setattr(features, "clean", lambda c: c)
    assert CATALOGUE.code_hash("ofi") not in before.values()


def test_one_file_per_date(spark, panel, tmp_path):
    days = panel.df.select("date").distinct()
    store = FeatureStore(panel.with_df(panel.df.repartition(8)), str(tmp_path / "s"), small_catalogue())
    store.write_stage("one", days)
    files = list((tmp_path / "s" / "one").glob("date=*/*.parquet"))
    assert len(files) == days.count()


def test_upstream_spreads(spark, panel, tmp_path):
    days = sorted(r["date"] for r in panel.df.select("date").distinct().collect())[:2]
    root = str(tmp_path / "s")
    FeatureStore(panel, root, small_catalogue()).build(days)
    cat = small_catalogue()
    cat.stages["one"] = Stage("one", lambda p, d: d.withColumn("one", F.lit(1.0)), ["one"], groups={"g": ["one"]})
    reasons = FeatureStore(panel, root, cat).dirty(days)
    assert reasons["one"].code == "code" and reasons["two"] == Staleness("upstream", detail="one")


def test_oof_round_trip(spark, panel, tmp_path):
    rows = panel.df.select(
        F.lit("short").alias("profile"), F.lit("e").alias("experiment_id"), F.lit(0).alias("fold_id"), *KEYS, "fret12",
        F.col("midpx").alias("pred"),
    )
    append_oof(rows, str(tmp_path / "o"), "r1")
    assert load_member(spark, str(tmp_path / "o"), "r1", "short", "e").count() == 1000
    with pytest.raises(FileNotFoundError):
        load_member(spark, str(tmp_path / "o"), "r1", "short", "missing")


def test_resume_and_artefacts(spark, tmp_path):
    journal = Journal(spark, str(tmp_path / "results"), ["fold_id"], "fold_id int, status string")
    assert journal.finished() == set()
    journal.record({"fold_id": 0, "status": "ok"})
    journal.record({"fold_id": 1, "status": "error"})
    assert journal.finished() == {(0,)}
    save_run(str(tmp_path / "run"), "r1", {"folds": spark.range(3).toDF("fold_id")}, {"a": 1})
    assert spark.read.parquet(str(tmp_path / "run" / "folds")).where("run_id = 'r1'").count() == 3


# -- search ------------------------------------------------------------------------

SPACE = {"a": {"type": "choice", "values": [1, 2, 3]}, "b": {"type": "int", "low": 4, "high": 5}, "c": {"type": "uniform", "low": 0.0, "high": 1.0}}


def test_grid(spark):
    points = search.grid(spark, SPACE).orderBy("trial_id").collect()
    assert len(points) == 12 and [p["trial_id"] for p in points] == list(range(12))
    assert tuple(points[1])[1:] == (1, 4, 1.0)
    assert search.grid(spark, SPACE, {"a": {"type": "choice", "values": [9]}}).count() == 4
    assert search.grid(spark, {}).collect()[0]["trial_id"] == 0
    with pytest.raises(ValueError):
        search.grid(spark, {"a": {"type": "odd"}})


def test_random_trials(spark):
    a = search.random_trials(spark, SPACE, 50, 3).collect()
    assert a == search.random_trials(spark, SPACE, 50, 3).collect()
    assert {r["a"] for r in a} == {1, 2, 3} and all(4 <= r["b"] <= 5 and 0 <= r["c"] <= 1 for r in a)


def test_selection(spark):
    rows = [(0, 0.5, "ok"), (0, -0.1, "ok"), (1, 0.1, "ok"), (1, 0.2, "ok"), (2, 9.0, "error"), (3, None, "ok")]
    trials = search.trial_table(frame(spark, rows, "trial_id int, corr double, status string"))
    assert search.best_trial(trials).first()["trial_id"] == 0
    best = search.champion(trials)
    assert best.first()["trial_id"] == 1
    fold_list = spark.range(4).select(F.col("id").alias("fold_id"))
    assert search.screening_jobs(trials.select("trial_id"), fold_list, [42, 43, 44]).count() == 4 * 2 * 2
    cert = search.certification_jobs(best, fold_list, [42, 43, 44])
    assert cert.count() == 12 and {r["trial_id"] for r in cert.collect()} == {1}
    results = frame(spark, [("sweep", 0.1, 0.0, "ok"), ("sweep_delivery", 0.9, 0.0, "ok")], "profile string, val_corr double, val_r2 double, status string")
    assert search.certificate(results).first()["n_folds"] == 1


def test_sweep_picks_the_best_worst_fold(spark):
    def evaluate(point, fold_id, seed):
        if point["a"] == 3:
            raise RuntimeError("broken")
        return (0.1, 0.0) if point["a"] == 1 else (0.5 if fold_id % 2 else -0.2, 0.0)

    fold_list = spark.range(4).select(F.col("id").alias("fold_id"))
    out = scans.run_sweep(spark, {"a": SPACE["a"]}, fold_list, [42, 43, 44], evaluate)
    assert out["champion"].first()["trial_id"] == 0
    assert {r["trial_id"]: r["status"] for r in out["trials"].collect()} == {0: "ok", 1: "ok", 2: "error"}
    row = out["certificate"].first()
    assert row["n_folds"] == 12 and row["min"] == pytest.approx(0.1)


def test_sweep_resumes_and_reports_delivery(spark, tmp_path):
    calls = []

    def evaluate(point, fold_id, seed):
        calls.append((point["a"], fold_id, seed))
        return (9.0 if fold_id == 4 else point["a"] / 10 - fold_id / 100, 0.0)

    fold_list = spark.range(4).select(F.col("id").alias("fold_id"))
    stages = scans.Stages(spark, evaluate, str(tmp_path / "j"), workers=4)
    for most in (5, 9, None):
        stages.left = most
        try:
            out = stages.sweep({"a": SPACE["a"]}, fold_list, [42, 43, 44], delivery_fold=4)
            break
        except BrokenOff:
            assert most is not None
    assert len(calls) == len(set(calls)) + 4  # the champion's screening jobs come again as certification jobs
    assert out["champion"].first()["trial_id"] == 2 and out["certificate"].first()["n_folds"] == 12
    assert out["folds"].count() == 13 and out["delivery"].first()["corr"] == 9.0 and out["certificate"].first()["max"] < 1
    found = stages.search(search.grid(spark, {"a": SPACE["a"]}), fold_list, [1])
    assert found["best"].first()["a"] == 3 and found["trials"].count() == 3
    checked = stages.validate({"a": 2}, fold_list, [1, 2])
    assert checked["certificate"].first()["n_folds"] == 8 and checked["folds"].count() == 8


def test_early_stop(spark):
    rows = [([1.0, 0.9, 0.8, 0.7], 0.5, False), ([1.0, 0.9, 0.8, 0.9], 0.5, True), ([1.0, 0.9], 0.1, False), ([1.0, 1.0, 1.0], None, False)]
    df = frame(spark, rows, "curve array<double>, best double, want boolean")
    got = df.withColumn("got", search.should_stop(F.col("curve"), F.col("best")))
    assert got.where("got != want").count() == 0


def test_tokens_and_config():
    assert search.parse_member("run: exp") == ("run", "exp")
    with pytest.raises(ValueError):
        search.parse_member("run")
    assert search.parse_hyperparameters(["a=1", "b=0.5", "c=true", "d=x"]) == {"a": 1, "b": 0.5, "c": True, "d": "x"}
    one = search.RunConfig("r1", "sweep", protocol={"rolling_start": 1, "rolling_end": 2}, execution={"seeds": [1], "resume": True})
    two = search.RunConfig("r2", "sweep", protocol={"rolling_start": 1, "rolling_end": 2}, execution={"seeds": [1]})
    assert one.check().fingerprint() == two.fingerprint() and len(one.fingerprint()) == 16
    assert one.fingerprint() != search.RunConfig("r1", "sweep", execution={"seeds": [2]}).fingerprint()
    for bad in (dict(run_id="a b", stage="sweep"), dict(run_id="a", stage="odd"), dict(run_id="a", stage="sweep", protocol={"rolling_start": 3, "rolling_end": 2}),
                dict(run_id="a", stage="sweep", model={"adapter": "x"}, adapter={"kind": "y"})):
        with pytest.raises(ValueError):
            search.RunConfig(**bad).check()


def test_specs():
    assert specs.candidates(["C1_R02_plus_conditional_momentum"])[0].experiment_id == specs.BASELINE_ID
    assert len(specs.suite("quick")[0]) == 3 and specs.suite("gate", ["M_lgbm_d4"])[1] == ["expanding"]
    assert len({s.experiment_id for s in specs.SPECS}) == len(specs.SPECS)
    for s in specs.SPECS:
        assert catalogue_module.CATALOGUE.columns(s.groups or None)
    with pytest.raises(ValueError):
        specs.suite("gate")


# -- models ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(5)
    n = 800
    x = rng.normal(size=(n, 3)) * [1.0, 1e6, 1e-4] + [0.0, 1e8, 1.0]
    y = 2 * x[:, 0] - 3e-6 * x[:, 1] + rng.normal(size=n)
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})
    return spark.createDataFrame(pdf).repartition(5), pdf


def scaled(pdf):
    z = pdf[["a", "b", "c"]].to_numpy()
    return (z - z.mean(0)) / z.std(0), pdf["y"].to_numpy()


def test_ridge_is_exact(regression):
    df, pdf = regression
    z, y = scaled(pdf)
    want = np.linalg.solve(z.T @ z + 50 * np.eye(3), z.T @ (y - y.mean()))
    fit = models.ridge(models.moments(df, ["a", "b", "c"], ["y"]), 50.0)
    assert np.allclose(fit.scaled_coef, want, rtol=1e-9)
    got = fit.predict(df).select("a", "pred").toPandas().sort_values("a")["pred"].to_numpy()
    expected = (z @ want + y.mean())[np.argsort(pdf["a"].to_numpy())]
    assert np.allclose(got, expected, rtol=1e-6, atol=1e-6)
    with pytest.raises(ValueError):
        models.ridge(models.moments(df, ["a"], ["y"]), 0.0)


def test_elastic_net_satisfies_its_conditions(regression):
    df, pdf = regression
    z, y = scaled(pdf)
    b = models.elastic_net(models.moments(df, ["a", "b", "c"], ["y"]), 0.5, 0.5).scaled_coef
    slope = z.T @ (y - y.mean() - z @ b) / len(y) - 0.25 * b
    assert np.all(np.abs(slope[b == 0]) <= 0.25 + 1e-9)
    assert np.allclose(slope[b != 0], 0.25 * np.sign(b[b != 0]), atol=1e-8)


def test_huber_and_trees_learn(spark, regression):
    df, _ = regression
    for name, params in (("huber", {"max_iter": 50}), ("tree", {"numTrees": 5, "minInstancesPerNode": 5, "maxDepth": 5}), ("gbdt", {"maxIter": 5, "minInstancesPerNode": 5})):
        fit = models.fit_columns(df, ["a", "b", "c"], "y", name, params)
        row = fit.predict(df).agg(F.corr("pred", "y").alias("r")).first()
        assert row["r"] > 0.7, name
        assert fit.weights(spark).count() == 3
    with pytest.raises(ValueError):
        models.fit_columns(df, ["a"], "y", "odd")


def bars_with(spark, label):
    """Bars whose label is the current signal, the next one, or noise."""
    rng = np.random.default_rng(3)
    rows = []
    for date in range(1, 9):
        for symbol in range(5):
            c0 = rng.normal(size=31)
            y = {"current": c0[:30] + 0.1 * rng.normal(size=30), "future": c0[1:], "noise": rng.normal(size=30)}[label]
            rows += [(date, symbol, i, float(c0[i]), float(rng.normal()), float(y[i])) for i in range(30)]
    return frame(spark, rows, "date bigint, symbol bigint, bar bigint, c0 double, c1 double, fret12 double")


@pytest.mark.parametrize("label, low, high", [("current", 0.5, 1.0), ("future", -0.2, 0.2), ("noise", -0.2, 0.2)])
def test_reference_models_do_not_leak(spark, label, low, high):
    p = plain_panel(bars_with(spark, label))
    w = sequences.gather_windows(p, p.df, ["c0", "c1"], 4)
    rows = w.select("date", "label", F.col("x")[3][0].alias("a"), F.col("x")[3][1].alias("b"))
    assert rows.count() == 8 * 5 * 27
    fit = models.least_squares(models.moments(rows.where("date <= 5"), ["a", "b"], ["label"]))
    score = fit.predict(rows.where("date > 6")).agg(*metrics.pooled()).first()
    assert low < score["corr"] <= high or abs(score["corr"]) <= high and label != "current"
    zero = models.ZeroFit().predict(rows).agg(*metrics.pooled()).first()
    assert zero["corr"] == 0.0


def test_normalizer_uses_training_rows_only(spark):
    p = plain_panel(bars_with(spark, "noise"))
    shifted = p.df.withColumn("c0", F.col("c0") + F.when(F.col("date") > 5, 100.0).otherwise(0.0))
    norm = sequences.Normalizer(["c0"]).fit(shifted.where("date <= 5"))
    train = norm.transform(shifted).where("date <= 5").agg(F.avg("c0"), F.stddev_pop("c0")).first()
    assert train[0] == pytest.approx(0.0, abs=1e-9) and train[1] == pytest.approx(1.0)
    with pytest.raises(RuntimeError):
        sequences.Normalizer(["c0"]).transform(shifted)
    assert norm.statistics().count() == 1


def test_protocol_run_and_engine(spark, sf_dir, tmp_path):
    p = panel_from_events(spark, sf_dir)
    cal = calendar_table(p.df.select(F.col("date").alias("day")))
    profile = folds.Profile("short_8d_2d", val_days=2, step=5, train_days=8, min_train_days=8)
    broken = Spec("broken", ("legacy",), "odd")
    out = protocol.run_protocol(
        p, cal, [profile], [Spec(specs.BASELINE_ID, ("legacy",)), broken], folds.PROFILE_WEIGHTS, max_folds=1
    )
    rows = {r["experiment_id"]: r for r in out["fold_metrics"].collect()}
    assert rows["broken"]["status"] == "error" and "odd" in rows["broken"]["error_msg"]
    assert rows[specs.BASELINE_ID]["status"] == "ok" and rows[specs.BASELINE_ID]["val_corr"] is not None
    assert out["leaderboard"].first()["decision"] == "baseline"
    store = FeatureStore(p, str(tmp_path / "store"))
    store.write_stage("base", p.df.select("date").distinct())
    read = protocol.run_profile(p, cal, profile, [Spec(specs.BASELINE_ID, ("legacy",))], 1, store=store).first()
    assert read["status"] == "ok" and read["val_corr"] == pytest.approx(rows[specs.BASELINE_ID]["val_corr"], abs=1e-3)
    results, both = str(tmp_path / "results"), [Spec(specs.BASELINE_ID, ("legacy",)), broken]
    first = protocol.run_profile(p, cal, profile, both, 1, results=results, store=store)
    again = protocol.run_profile(p, cal, profile, both, 1, results=results, store=store, workers=2)
    assert {r["status"] for r in first.collect()} == {r["status"] for r in again.collect()} == {"ok", "error"}
    # The finished job wasn't run again, the failed one was.
    held = {"review": ((20240101, 20240115), (20240116, 20240120)), "final": ((20240101, 20240120), (20240121, 20240130))}
    saved = protocol.run_protocol(
        p, cal, [profile], both, folds.PROFILE_WEIGHTS, max_folds=1, holdouts=held, results=results, save=(str(tmp_path / "runs"), "r1")
    )
    board = {r["experiment_id"]: r for r in saved["leaderboard"].collect()}
    assert board[specs.BASELINE_ID]["review_holdout_corr"] is not None and board[specs.BASELINE_ID]["final_holdout_mse"] > 0
    for name, n in (("folds", 1), ("fold_metrics", 2), ("profile_summary", 1), ("leaderboard", 1), ("holdouts", 4), ("resolved_columns", 2)):
        assert spark.read.parquet(str(tmp_path / "runs" / name)).where("run_id = 'r1'").count() == n
    journal = Journal(spark, results, protocol.JOB, protocol.RESULT_SCHEMA)
    assert journal.all_rows().groupBy("status").count().orderBy("status").collect() == [("error", 1), ("ok", 1)]
    before, after = ({r["status"]: r["runtime_sec"] for r in rows.collect()} for rows in (first, again))
    assert before["ok"] == after["ok"]
