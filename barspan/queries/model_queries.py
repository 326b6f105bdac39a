"""Store, models, search and engine as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barspan.functions.scalars import KEYS, LABEL
from barspan.operators import boosting, gram, models, protocol, scans, search
from barspan.operators.extra_trees import Forest, fit_forest
from barspan.operators.folds import date_range, delivery_fold, fold_days
from barspan.operators.metrics import correlation, pooled
from barspan.operators.sequences import gather_windows, stored_vectors
from barspan.operators.specs import MEMBERS, Spec
from barspan.plans.catalogue import BASE, CATALOGUE, CROSS_Z, build_features, written_features
from barspan.plans.digests import compared
from barspan.plans.tables import fresh_path, written
from barspan.queries.common import (
    BASELINE,
    SCALED_PROFILES,
    Query,
    both_members,
    calendar_of,
    member_a,
    member_b,
    panel_of,
    present,
    tall_members,
)
from barspan.sources.bars import Panel
from barspan.sources.journal import BrokenOff
from barspan.sources.predictions import append_oof, dump_scored, load_member
from barspan.sources.store import FeatureStore

QUERIES: dict[str, Query] = {}
TRAIN, VAL = (20240101, 20240120), (20240122, 20240130)
RIDGE_COLUMNS = ["obi0", "trade_imb"]
COUNTS = ["nTradeBuy", "nTradeSell", "nAddBuy", "nAddSell", "nCxlBuy", "nCxlSell"]


def over_panel(build):
    def run(spark, sf_dir):
        return build(panel_of(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


# -- store ------------------------------------------------------------------------


@over_panel
def a06_stage_round_trip(p: Panel) -> DataFrame:
    store = FeatureStore(p, fresh_path(p.spark, "store"))
    store.write_stage("base", p.df.select("date").distinct())
    return present(store.read_stage("base"), BASE, KEYS)


@over_panel
def a07_loaded_groups(p: Panel) -> DataFrame:
    store = FeatureStore(p, fresh_path(p.spark, "store"))
    for stage in CATALOGUE.resolve(["legacy", "norm_core"]):
        store.write_stage(stage, p.df.select("date").distinct())
    loaded = store.load(groups=["legacy", "norm_core"], dtype="float64")
    return present(loaded, [*CATALOGUE.columns(["legacy", "norm_core"]), LABEL], KEYS)


@over_panel
def a08_alignment(p: Panel) -> DataFrame:
    store = FeatureStore(p, fresh_path(p.spark, "store"))
    store.write_stage("base", p.df.select("date").distinct())
    return store.misaligned("base")


@over_panel
def a08_verified_dates(p: Panel) -> DataFrame:
    """A stored stage against its recomputation: as written, and with the first row of every third day of the month
    changed, missing or doubled."""
    store = FeatureStore(p, fresh_path(p.spark, "store"))
    store.write_stage("base", p.df.select("date").distinct())
    stored = store.read_stage("base")
    hit = stored.where(F.col("date") % 3 == 0).groupBy("date").agg(F.min(F.struct("symbol", "bar")).alias("_first"))
    marked = stored.join(hit, "date", "left").withColumn("_hit", F.struct("symbol", "bar").eqNullSafe(F.col("_first")))
    changed = F.when(F.col("_hit"), F.col(BASE[0]) + F.lit(1.0)).otherwise(F.col(BASE[0])).cast("float")
    kinds = {
        "whole": marked, "changed": marked.withColumn(BASE[0], changed), "missing": marked.where(~F.col("_hit")),
        "doubled": marked.unionByName(marked.where("_hit")),
    }
    wanted = store.computed("base", p.df.select("date").distinct())
    found, by, columns = None, ["kind", "date"], [*KEYS[1:], *BASE]
    for kind, df in kinds.items():
        rows = compared(df.withColumn("kind", F.lit(kind)), wanted.withColumn("kind", F.lit(kind)), by, columns)
        found = rows if found is None else found.unionByName(rows)
    return found.select(*by, "n_left", "n_right", F.col("same").cast("bigint").alias("same"))


@over_panel
def a09_stale_stages(p: Panel) -> DataFrame:
    """Why a stage is stale, step by step: nothing built, half of the days built, all built, another version, forced."""
    root = fresh_path(p.spark, "store")
    store = FeatureStore(p, root)
    days = sorted(r["date"] for r in p.df.select("date").distinct().collect())
    half, rows = days[: len(days) // 2], []

    def step(name: str, stale: dict) -> None:
        found = stale.get("rx_micro")
        rows.append((name, found.code if found else "ok", str(found.detail or "") if found else "", store.built_days("rx_micro").count()))

    step("new", store.dirty(half, stages=["rx_micro"]))
    step("half", store.build(half, stages=["rx_micro"]))
    step("more", store.build(stages=["rx_micro"]))
    step("again", store.build(stages=["rx_micro"]))
    step("version", FeatureStore(p, root, version="2").dirty(stages=["rx_micro"]))
    step("force", store.dirty(force=True, stages=["rx_micro"]))
    return p.spark.createDataFrame(rows, "step string, code string, detail string, n_days bigint")


@over_panel
def a10_incremental_build(p: Panel) -> DataFrame:
    """A stage built in two parts holds what one build gives, date by date."""
    store = FeatureStore(p, fresh_path(p.spark, "store"))
    days = sorted(r["date"] for r in p.df.select("date").distinct().collect())
    store.build(days[::2], stages=["rx_micro"])
    store.build(stages=["rx_micro"])
    return store.verify("rx_micro").withColumn("same", F.col("same").cast("bigint"))


@over_panel
def a12_appended_predictions(p: Panel) -> DataFrame:
    """Predictions appended fold by fold, counted by member and fold."""
    root = fresh_path(p.spark, "oof")
    days = fold_days(calendar_of(p), SCALED_PROFILES[:1]).where(F.col("segment") == "val")
    rows = written(tall_members(p).withColumnRenamed("label", LABEL).join(days, "date"), "predictions")
    for fold in sorted(r["fold_id"] for r in days.select("fold_id").distinct().collect()):
        append_oof(rows.where(F.col("fold_id") == fold), root, "run_1")
    members = [load_member(p.spark, root, "run_1", "short_8d_2d", m).withColumn("experiment_id", F.lit(m)) for m in (BASELINE, "X1_book")]
    both = members[0].unionByName(members[1])
    out = both.groupBy("experiment_id", "fold_id").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("pred").alias("pred"))
    return present(out, ["pred"], ["experiment_id", "fold_id", "n_rows"])


@over_panel
def a11_store_status(p: Panel) -> DataFrame:
    store = FeatureStore(p, fresh_path(p.spark, "store"))
    store.build(stages=["rx_micro"])
    return store.status().select("stage", "state", "reason", "n_days", "n_columns")


@over_panel
def a13_member_round_trip(p: Panel) -> DataFrame:
    root = fresh_path(p.spark, "oof")
    days = fold_days(calendar_of(p), SCALED_PROFILES[:1]).where(F.col("segment") == "val")
    rows = tall_members(p).withColumnRenamed("label", LABEL).join(days, "date")
    append_oof(rows, root, "run_1")
    return present(
        load_member(p.spark, root, "run_1", "short_8d_2d", "X1_book"), [LABEL, "pred"], ["fold_id", *KEYS]
    )


@over_panel
def a14_scored_rows(p: Panel) -> DataFrame:
    path = fresh_path(p.spark, "scored")
    dump_scored(member_b(p), path)
    return present(p.spark.read.parquet(path).withColumn("date", F.col("date").cast("bigint")), ["label", "pred"], KEYS)


# -- models -----------------------------------------------------------------------


def _features(p: Panel, groups: list[str]) -> DataFrame:
    """Features as a written table: training and scoring read them several times."""
    return written(build_features(p, groups), "features")


def _scored(rows: DataFrame) -> DataFrame:
    return present(rows, ["pred"], KEYS)


@over_panel
def h01_ridge(p: Panel) -> DataFrame:
    rows = _features(p, ["base"])
    fit = models.ridge(models.moments(date_range(rows, *TRAIN), RIDGE_COLUMNS, [LABEL]), 2.0)
    return _scored(fit.predict(rows))


@over_panel
def h02_elastic_net(p: Panel) -> DataFrame:
    rows = _features(p, ["base"])
    fit = models.elastic_net(models.moments(date_range(rows, *TRAIN), ["obi0"], [LABEL]), 1e-7, 0.1)
    return _scored(fit.predict(rows))


@over_panel
def h03_huber(p: Panel) -> DataFrame:
    rows = _features(p, ["legacy"])
    fit = models.fit_model(p, date_range(rows, *TRAIN), CATALOGUE.columns(["legacy"]), "huber")
    return _scored(fit.predict(rows))


@over_panel
def h04_forest(p: Panel) -> DataFrame:
    """The shallow preset as it is: 300 extra-random trees."""
    rows = _features(p, ["legacy"])
    fit = models.fit_model(p, date_range(rows, *TRAIN), CATALOGUE.columns(["legacy"]), "tree_shallow")
    return _scored(fit.predict(rows))


RANDOM_CUTS = Forest(trees=3, depth=2, least_rows=50, column_share=1.0, sample_share=None)


@over_panel
def h04_random_cuts(p: Panel) -> DataFrame:
    """Three extra-random trees of two levels on the order counts, every row once."""
    return _scored(fit_forest(date_range(p.df, *TRAIN), COUNTS, LABEL, RANDOM_CUTS, KEYS).predict(p.df))


@over_panel
def h05_boosted_trees(p: Panel) -> DataFrame:
    """Leaf-wise boosting on all training rows: 31 leaves, depth 6, fewer rounds and smaller leaves than the preset's.

    The labels are returns of about 1e-4, so the L1 penalty is one of their size.
    """
    rows = _features(p, ["legacy"])
    small = {"rounds": 20, "least_rows": 50, "l1": 1e-4}
    fit = models.fit_model(p, date_range(rows, *TRAIN), CATALOGUE.columns(["legacy"]), "lgbm", params=small)
    return _scored(fit.predict(rows))


FIRST_TREE = boosting.Boosting(rounds=1, rate=1.0, leaves=3, depth=2, least_rows=50, column_share=1.0, l1=1e-4, l2=0.1)


@over_panel
def h05_first_tree(p: Panel) -> DataFrame:
    """One leaf-wise tree with two splits on the order counts."""
    fit = boosting.boost(date_range(p.df, *TRAIN), COUNTS, LABEL, FIRST_TREE)
    return _scored(fit.predict(p.df))


@over_panel
def h06_family_importance(p: Panel) -> DataFrame:
    """Families ranked by the absolute correlation of their columns with the label."""
    columns = [*BASE, *CROSS_Z]
    rows = build_features(p, ["base", "legacy", "cross_z"])
    kept = [c for c in columns if c in rows.columns]
    wide = rows.agg(*[F.coalesce(correlation(F.col(c), F.col(LABEL)), F.lit(0.0)).alias(c) for c in kept])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(c).alias("abs_coef")) for c in kept])
    out = models.family_importance(wide.select(F.inline(pairs)))
    return present(out, ["importance_sum", "top_importance", "importance_share"], ["family", "n_features"])


@over_panel
def h07_common_residual(p: Panel) -> DataFrame:
    rows = _features(p, ["base"])
    out = protocol.common_residual(
        p, date_range(rows, *TRAIN), date_range(rows, *VAL), CATALOGUE.columns(["base"]), "ridge"
    )
    return _scored(out["val"])


@over_panel
def h07_lambda_grid(p: Panel) -> DataFrame:
    """Scores of the weights of a common part: the cross-section mean of one member beside what it leaves of the other."""
    rows = both_members(p)
    means = rows.groupBy("date", "bar").agg(F.avg("pred_a").alias("common"))
    rows = rows.join(means, ["date", "bar"]).withColumn("residual", F.col("pred_b") + F.col("pred_a") - F.col("common"))
    out = protocol.lambda_grid(rows).withColumn("mse", F.col("mse") * F.lit(1e9))
    return present(out, ["weight", "corr", "mse", "r2"])


@over_panel
def h08_soft_regime(p: Panel) -> DataFrame:
    rows = written_features(p, ["base", "lag", "roll", "cross", "regime"], exact=protocol.REGIME_META)
    out = protocol.soft_regime(p, date_range(rows, *TRAIN), date_range(rows, *VAL))
    return _scored(out["val"])


@over_panel
def h09_interval_ridge(p: Panel) -> DataFrame:
    return present(models.interval_onehot_ridge(p.df, LABEL), ["pred"], ["bar"])


@over_panel
def h10_rescaled(p: Panel) -> DataFrame:
    by = ["experiment_id"]
    rows = tall_members(p)
    fitted = models.ols_rescale(date_range(rows, *TRAIN), by)
    return present(models.apply_rescale(rows, fitted, by), ["pred"], ["experiment_id", *KEYS])


@over_panel
def h11_reference_models(p: Panel) -> DataFrame:
    """Pooled correlation of the zero, last-step and window-mean references."""
    channels = ["bsize0", "asize0"]
    windows = gather_windows(p, p.df, channels, 6)
    last = {c: F.col("x")[5][i] for i, c in enumerate(channels)}
    mean = {
        f"mean_{c}": sum((F.col("x")[t][i] for t in range(1, 6)), F.col("x")[0][i]) / F.lit(6.0)
        for i, c in enumerate(channels)
    }
    rows = windows.select(*KEYS, F.col("label").alias(LABEL), *[e.alias(n) for n, e in (last | mean).items()])
    train = date_range(rows, *TRAIN)
    m = models.moments(train, [*last, *mean], [LABEL])
    fits = {"zero": models.ZeroFit()}
    for name, columns in (("last_step", list(last)), ("window_mean", list(mean))):
        at = [m.columns.index(c) for c in columns]
        part = models.Moments(
            columns, m.targets, m.n, m.mean[at], m.scale[at], m.target_mean, m.xx[at][:, at], m.xy[at], m.yy
        )
        fits[name] = models.least_squares(part)
    for name, fit in fits.items():
        rows = fit.predict(rows, f"p_{name}")
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"p_{n}").alias("pred")) for n in fits])
    tall = rows.select(F.col(LABEL).alias("label"), F.inline(pairs))
    return present(tall.groupBy("model").agg(*pooled()), ["mse", "corr", "r2"], ["model"])


@over_panel
def h12_members(p: Panel) -> DataFrame:
    """Both default members as they are: all their feature families, 300 boosting rounds, leaves of 200 rows.

    The labels are returns of about 1e-4, so the L1 penalty is one of their size.
    """
    return _scored(protocol.run_engine(p, MEMBERS, TRAIN, VAL, params={"M_lgbm_d4": {"l1": 1e-4}}))


@over_panel
def h13_seed_average(p: Panel) -> DataFrame:
    seeds = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(w).alias("w")) for s, w in ((42, 0.9), (43, 1.0), (44, 1.2))])).alias("s")
    rows = member_b(p).select(*KEYS, "pred", seeds).withColumn("pred", F.col("pred") * F.col("s.w"))
    return present(models.seed_average(rows, KEYS), ["pred_dl"], [*KEYS, "n_seeds"])


SCORES = [
    "train_corr", "train_mse", "train_r2", "val_corr", "val_mse", "val_r2", "daily_corr_mean", "daily_corr_std",
    "train_val_corr_gap",
]
R00, R02 = Spec("R00_ridge_legacy", ("legacy",)), Spec(BASELINE, ("legacy", "norm_core"))


def _fold_scores(rows: DataFrame) -> DataFrame:
    return present(rows, SCORES, ["profile", "fold_id", "experiment_id", "n_train_days", "n_val_days"])


@over_panel
def h14_protocol_run(p: Panel) -> DataFrame:
    """The ridge reference spec trained and scored on the folds of the short profile."""
    return _fold_scores(protocol.run_profile(p, calendar_of(p), SCALED_PROFILES[0], [R00]))


@over_panel
def h14_resumed_run(p: Panel) -> DataFrame:
    """The same run, broken off after two jobs and resumed from its journal with four jobs in flight."""
    results = fresh_path(p.spark, "results")
    try:
        protocol.run_profile(p, calendar_of(p), SCALED_PROFILES[0], [R00], results=results, workers=2, most=2)
    except BrokenOff:
        pass
    return _fold_scores(protocol.run_profile(p, calendar_of(p), SCALED_PROFILES[0], [R00], results=results, workers=4))


def _gram_run(p: Panel) -> DataFrame:
    features = protocol.shared_features(p, ["legacy", "norm_core"])
    return gram.linear_protocol(features, calendar_of(p), SCALED_PROFILES[:2], [R00, R02])


@over_panel
def h14_gram_run(p: Panel) -> DataFrame:
    """Two ridge specs on all folds of two profiles, from one pass over the features."""
    return _fold_scores(_gram_run(p))


@over_panel
def h14_coefficients(p: Panel) -> DataFrame:
    """Standardized coefficients (times 1e6) of both specs in every fold."""
    rows = gram.weights(_gram_run(p)).withColumns({c: F.col(c) * 1e6 for c in ("coef", "abs_coef")})
    return present(rows, ["coef", "abs_coef"], ["profile", "fold_id", "experiment_id", "feature"])


@over_panel
def k10_engine(p: Panel) -> DataFrame:
    """Fit on one window, score another, fuse with a second model where it scored."""
    second = member_b(p).select(*KEYS, F.col("pred").alias("pred_dl"))
    member = [Spec("R00_ridge_legacy", ("legacy",))]
    return present(protocol.run_engine(p, member, TRAIN, VAL, second), ["pred", "fused"], KEYS)


# -- search -------------------------------------------------------------------------


def _trials(p: Panel) -> DataFrame:
    """Blend weights as trials, scored on the validation days of the short profile."""
    days = fold_days(calendar_of(p), SCALED_PROFILES[:1]).where(F.col("segment") == "val").select("date", "fold_id")
    weights = F.posexplode(F.array(*[F.lit(w / 4) for w in range(5)])).alias("trial_id", "weight")
    rows = both_members(p).join(days, "date").select("fold_id", "label", "pred_a", "pred_b", weights)
    mixed = F.col("weight") * F.col("pred_a") + (F.lit(1.0) - F.col("weight")) * F.col("pred_b")
    per_fold = rows.groupBy(F.col("trial_id").cast("bigint").alias("trial_id"), "fold_id").agg(
        correlation(mixed, F.col("label")).alias("corr")
    )
    return search.trial_table(per_fold.withColumn("status", F.lit("ok")))


TRIAL = ["screen_corr_mean", "screen_corr_min", "screen_corr_std"]


@over_panel
def l03_best_trial(p: Panel) -> DataFrame:
    trials = _trials(p)
    ranked = trials.withColumn("pick", F.lit("all")).unionByName(search.best_trial(trials).withColumn("pick", F.lit("best")))
    return present(ranked, TRIAL, ["pick", "trial_id", "n_evals"])


@over_panel
def l04_champion(p: Panel) -> DataFrame:
    return present(search.champion(_trials(p)), TRIAL, ["trial_id", "n_evals"])


@over_panel
def l06_early_stop(p: Panel) -> DataFrame:
    """Daily squared errors of each member as its loss curve."""
    daily = tall_members(p).groupBy("experiment_id", "date").agg(
        F.avg((F.col("pred") - F.col("label")) * (F.col("pred") - F.col("label"))).alias("mse")
    )
    curves = daily.groupBy("experiment_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("date", "mse"))), lambda d: d["mse"]).alias("curve")
    )
    stop = search.should_stop(F.col("curve"), F.lit(3e-6))
    return curves.select("experiment_id", F.size("curve").cast("bigint").alias("n"), stop.cast("bigint").alias("stop"))


@over_panel
def l07_ridge_scan(p: Panel) -> DataFrame:
    """All label clips and ridge strengths on the folds of the short profile."""
    out = scans.ridge_scan(p, calendar_of(p), SCALED_PROFILES[0], ["legacy"])
    return present(out, ["alpha", "corr_mean", "daily_ic_mean", "stability_score"], ["clip", "n_folds"])


@over_panel
def l10_feature_probe(p: Panel) -> DataFrame:
    old, new = Spec("old", ("legacy",)), Spec("new", ("legacy", "rx_micro"))
    out = scans.feature_probe(p, calendar_of(p), SCALED_PROFILES[1], old, new)
    return present(out, ["old_val_corr", "new_val_corr", "delta_val_corr", "old_val_mse", "new_val_mse"], ["fold_id"])


# Ridge strengths as a search space; a seed leaves out the training dates with date + seed divisible by 7.
SPACE, SEEDS = {"alpha": {"type": "choice", "values": [0.5, 2.0, 200.0]}}, [42, 43, 44]
DELIVERY_TRAIN_END = 20240124


def _stages(p: Panel) -> tuple[scans.Stages, DataFrame, int]:
    """Search stages over ridge fits on the short profile's folds, four jobs in flight; the folds; the delivery fold."""
    columns = CATALOGUE.columns(["legacy"])
    blocks = written(gram.date_blocks(protocol.shared_features(p, ["legacy"]), columns), "blocks")
    calendar = calendar_of(p)
    days: dict[int, dict[str, list[int]]] = {}
    for r in fold_days(calendar, SCALED_PROFILES[:1]).collect():
        days.setdefault(r["fold_id"], {"train": [], "val": []})[r["segment"]].append(r["date"])
    last = max(days) + 1
    names = {"train_core": "train", "earlystop": "train", "scoring": "val"}
    for r in delivery_fold(calendar, DELIVERY_TRAIN_END, 20240130, 1, last).where("segment != 'embargo'").collect():
        days.setdefault(last, {"train": [], "val": []})[names[r["segment"]]].append(r["day"])

    def evaluate(point: dict, fold_id: int, seed: int) -> tuple[float, float]:
        train = [d for d in days[fold_id]["train"] if (d + seed) % 7]
        fit = gram.fit_dates(blocks, columns, R00, train, point["alpha"])
        found = gram.score_dates(blocks, columns, fit, days[fold_id]["val"])
        return found["corr"], found["r2"]

    folds = p.spark.createDataFrame([(f,) for f in sorted(days) if f < last], "fold_id long")
    return scans.Stages(p.spark, evaluate, fresh_path(p.spark, "stages"), workers=4), folds, last


def _broken_sweep(p: Panel) -> dict[str, DataFrame]:
    """A sweep broken off twice, in its first and in its second tier, and resumed."""
    stages, folds, delivery = _stages(p)
    for most in (5, 12, None):
        stages.left = most
        try:
            return stages.sweep(SPACE, folds, SEEDS, delivery_fold=delivery)
        except BrokenOff:
            continue
    raise AssertionError("the last run has no bound")


@over_panel
def l04_sweep_folds(p: Panel) -> DataFrame:
    """The champion on all folds and seeds, and on the delivery fold."""
    return present(_broken_sweep(p)["folds"], ["corr", "val_r2"], ["profile", "trial_id", "fold_id", "seed"])


CERTIFICATE = ["mean", "std", "min", "max", "positive_rate", "val_r2_mean", "val_r2_min"]


@over_panel
def l04_sweep_certificate(p: Panel) -> DataFrame:
    return present(_broken_sweep(p)["certificate"], CERTIFICATE, ["n_folds"])


@over_panel
def l05_search_trials(p: Panel) -> DataFrame:
    """All trials of the search stage and its winner."""
    stages, folds, _ = _stages(p)
    out = stages.search(search.grid(p.spark, SPACE), folds, SEEDS[:2])
    picked = out["best"].drop("alpha").withColumn("pick", F.lit("best"))
    return present(out["trials"].withColumn("pick", F.lit("all")).unionByName(picked), TRIAL, ["pick", "trial_id", "n_evals"])


@over_panel
def l05_validation(p: Panel) -> DataFrame:
    """The summary of one frozen configuration on all folds and seeds; an error where one of them failed, since a summary
    of the others would look like the whole."""
    stages, folds, _ = _stages(p)
    found = stages.validate({"alpha": 2.0}, folds, SEEDS)
    scans.all_succeeded(found["folds"])
    return present(found["certificate"], CERTIFICATE, ["n_folds"])


@over_panel
def i09_stored_vectors(p: Panel) -> DataFrame:
    """Flat vectors of stored columns with the labels of the bars, keys proven equal."""
    store = FeatureStore(p, fresh_path(p.spark, "store"))
    store.write_stage("base", p.df.select("date").distinct())
    out = stored_vectors(store, ["base"], p.df.select(*KEYS, LABEL))
    cells = {f"x_{c}": F.col("x")[i] for i, c in enumerate(CATALOGUE.columns(["base"]))}
    return present(out.withColumns(cells), [*cells, "label"], KEYS)


@over_panel
def c06_feature_families(p: Panel) -> DataFrame:
    """Family of every built column, with the rows that hold it."""
    names = F.explode(F.array(*[F.lit(c) for c in CATALOGUE.columns()])).alias("feature")
    counted = p.df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))
    tall = counted.select("n_rows", names).withColumn("family", models.feature_family(F.col("feature")))
    return tall.groupBy("feature", "family").agg(F.sum("n_rows").alias("n_rows"))


@over_panel
def c07_member_tokens(p: Panel) -> DataFrame:
    text = p.df.select(
        *KEYS,
        F.concat(F.lit("run_"), F.col("date").cast("string"), F.lit(": exp_"), F.col("symbol").cast("string")).alias("token"),
        F.concat(F.lit("alpha="), F.col("symbol").cast("string"), F.lit(",depth="), F.col("bar").cast("string")).alias("pairs"),
    )
    params = search.hyperparameters(F.col("pairs"))
    return text.select(
        *KEYS,
        *[c.alias(n) for n, c in search.member_token(F.col("token")).items()],
        params["alpha"].alias("alpha"),
        params["depth"].alias("depth"),
    )
