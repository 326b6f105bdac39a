"""Scans, calendar, folds, labels, sequences, metrics, blends and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barspan.functions.scalars import KEYS, LABEL, clean, div_abs, div_eps, flag
from barspan.operators import blend, folds, labels, leaderboard, metrics, sequences
from barspan.operators.protocol import fold_metrics
from barspan.plans.catalogue import CATALOGUE, build_features
from barspan.plans.tables import written
from barspan.queries.common import (
    BASELINE,
    SCALED_PROFILES,
    SCALED_WEIGHTS,

    Query,
    both_members,
    calendar_of,
    dates_of,

    member_a,
    member_b,
    panel_of,
    present,
    tall_members,
    weekday_calendar,
)
from barspan.sources import bars, calendar
from barspan.sources.bars import CHANNELS, Panel
from barspan.sources.predictions import average_duplicates, pending_jobs

QUERIES: dict[str, Query] = {}


def over_panel(build):
    """Register a function of the panel under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(panel_of(spark, sf_dir))

    run.over = build
    QUERIES[build.__name__] = run
    return build


@over_panel
def flagship_daily_ic(p: Panel) -> DataFrame:
    """Per-day correlation of cross-sectional order pressure with the forward return."""
    scored = build_features(p, ["cross_z"]).select(
        "date", F.col("order_pressure_cs_z").alias("pred"), F.col(LABEL).alias("label")
    )
    out = metrics.group_correlation(scored, ["date"])
    return present(out.withColumn("ic", F.coalesce("ic", F.lit(0.0))), ["ic"], ["date", "n_rows"])


# -- scans ------------------------------------------------------------------------


@over_panel
def a01_scan_days(p: Panel) -> DataFrame:
    return present(bars.scan_days(p, calendar_of(p)), [*CHANNELS, LABEL], KEYS)


@over_panel
def a02_count_per_day(p: Panel) -> DataFrame:
    return bars.count_per_day(p)


@over_panel
def a03_available_days(p: Panel) -> DataFrame:
    return bars.available_days(p, weekday_calendar(p))


@over_panel
def a04_first_symbols(p: Panel) -> DataFrame:
    return present(bars.first_symbols(p, 5), ["midpx", LABEL], KEYS)


@over_panel
def a05_keys_and_label(p: Panel) -> DataFrame:
    return present(bars.keys_and_label(p), [LABEL], KEYS)


@over_panel
def a15_average_duplicates(p: Panel) -> DataFrame:
    return present(average_duplicates([member_a(p), member_b(p)]), ["pred", "label"], KEYS)


@over_panel
def a16_pending_fold_jobs(p: Panel) -> DataFrame:
    done = _fold_metrics(p).withColumn(
        "status", F.when(F.col("val_corr") > 0, F.lit("ok")).otherwise(F.lit("error"))
    )
    return pending_jobs(done.select("profile", "fold_id", "experiment_id"), done, ["profile", "fold_id", "experiment_id"])


@over_panel
def a17_pending_seed_folds(p: Panel) -> DataFrame:
    seeds = F.explode(F.array(F.lit(42), F.lit(43), F.lit(44))).alias("seed")
    fold_list = folds.fold_table(calendar_of(p), SCALED_PROFILES[3]).select("fold_id", "val_start", seeds)
    done = fold_list.where((F.col("fold_id") + F.col("seed")) % 2 == 0).withColumn("status", F.lit("ok"))
    return pending_jobs(fold_list, done, ["seed", "fold_id"])


# -- calendar ---------------------------------------------------------------------


@over_panel
def b01_trading_days(p: Panel) -> DataFrame:
    return calendar.is_trading_day(dates_of(p), weekday_calendar(p))


@over_panel
def b02_same_or_next_day(p: Panel) -> DataFrame:
    return calendar.same_or_next(dates_of(p), weekday_calendar(p))


@over_panel
def b03_next_and_previous_day(p: Panel) -> DataFrame:
    return calendar.neighbours(dates_of(p), weekday_calendar(p))


@over_panel
def b04_shifted_day(p: Panel) -> DataFrame:
    return calendar.shift(dates_of(p), weekday_calendar(p), 3)


@over_panel
def b05_days_around(p: Panel) -> DataFrame:
    out = calendar.around(dates_of(p), weekday_calendar(p), 4)
    joined = lambda c: F.array_join(F.transform(c, lambda d: d.cast("string")), ",")
    return out.select("date", joined("days_before").alias("days_before"), joined("days_after").alias("days_after"))


@over_panel
def b06_day_range(p: Panel) -> DataFrame:
    return calendar.day_range(weekday_calendar(p), 20240106, 20240121)


@over_panel
def b07_automatic_split(p: Panel) -> DataFrame:
    return calendar.automatic_split(calendar_of(p), 20)


# -- scalars ----------------------------------------------------------------------


@over_panel
def c01_division_abs(p: Panel) -> DataFrame:
    d = div_abs(F.col("tradeBuyTurnover"), F.col("tradeBuyQty") - F.col("tradeSellQty"))
    return present(p.df.withColumn("ratio", d), ["ratio"], KEYS)


@over_panel
def c02_division_signed(p: Panel) -> DataFrame:
    d = div_eps(F.col("tradeBuyTurnover"), F.col("tradeBuyQty") - F.col("tradeSellQty"))
    return present(p.df.withColumn("ratio", d), ["ratio"], KEYS)


@over_panel
def c03_cleaned_channels(p: Panel) -> DataFrame:
    return present(p.df.withColumns({c: clean(F.col(c)) for c in CHANNELS}), CHANNELS, KEYS)


@over_panel
def c04_scalar_functions(p: Panel) -> DataFrame:
    gap = F.col("lastpx") - F.col("midpx")
    out = p.df.withColumns(
        {
            "sign_gap": F.signum(gap),
            "abs_gap": F.abs(gap),
            "clipped": F.greatest(F.least(gap, F.lit(0.01)), F.lit(-0.01)),
            "log1p_qty": F.log1p("tradeBuyQty"),
            "log_floor": F.log(F.greatest(F.col("lastpx"), F.lit(1e-9))),
            "is_up": flag(gap > 0),
        }
    )
    return present(out, ["sign_gap", "abs_gap", "clipped", "log1p_qty", "log_floor", "is_up"], KEYS)


@over_panel
def c05_date_and_symbol_sets(p: Panel) -> DataFrame:
    chosen = weekday_calendar(p).select(F.col("day").alias("date"))
    kept = sequences.only_dates(p.df, chosen).where(F.col("symbol").isin([1, 3, 5, 7, 9]))
    return present(kept, ["midpx"], KEYS)


# -- folds ------------------------------------------------------------------------


@over_panel
def e05_features_for_groups(p: Panel) -> DataFrame:
    return present(build_features(p, ["legacy", "norm_core"]), [*CATALOGUE.columns(["legacy", "norm_core"]), LABEL], KEYS)


@over_panel
def f01_sliding_folds(p: Panel) -> DataFrame:
    c = calendar_of(p)
    return folds.fold_table(c, SCALED_PROFILES[0]).unionByName(folds.fold_table(c, SCALED_PROFILES[1]))


@over_panel
def f02_expanding_folds(p: Panel) -> DataFrame:
    return folds.fold_table(calendar_of(p), SCALED_PROFILES[3])


@over_panel
def f03_simple_folds(p: Panel) -> DataFrame:
    c = calendar_of(p)
    some = folds.simple_folds(c, 10, 4, 4, min_train_days=10).withColumn("kind", F.lit("regular"))
    none = folds.simple_folds(c, 40, 10, 10).withColumn("kind", F.lit("fallback"))
    return some.unionByName(none)


@over_panel
def f05_recent_folds(p: Panel) -> DataFrame:
    cut = folds.recent_splits(calendar_of(p), 3, 3, 1, 10, 4)
    first, last = (lambda c: F.element_at(c, 1)), (lambda c: F.element_at(c, -1))
    return cut.select(
        "fold_id", last("train").alias("train_end"), first("val").alias("val_start"), last("val").alias("val_end")
    )


@over_panel
def f06_early_stop_lengths(p: Panel) -> DataFrame:
    sizes = calendar_of(p).select((F.col("pos") + F.lit(1)).cast("int").alias("n"))
    return sizes.select(
        F.col("n").cast("bigint").alias("n"),
        folds.early_stop_days(F.col("n"), folds.EARLY_STOP_SHARE).cast("bigint").alias("tail"),
    )


@over_panel
def f07_four_segment_folds(p: Panel) -> DataFrame:
    c = calendar_of(p)
    first = folds.four_segment_folds(c, SCALED_PROFILES[3]).withColumn("pick", F.lit("first"))
    recent = folds.four_segment_folds(c, SCALED_PROFILES[3], "recent", 3).withColumn("pick", F.lit("recent"))
    return first.unionByName(recent)


@over_panel
def f08_delivery_fold(p: Panel) -> DataFrame:
    return folds.delivery_fold(calendar_of(p), 20240122, 20240130, embargo=2)


@over_panel
def f09_causality_violations(p: Panel) -> DataFrame:
    days = folds.four_segment_folds(calendar_of(p), SCALED_PROFILES[3])
    return days.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n_days")).join(
        folds.causality_violations(days).groupBy("fold_id").agg(F.count(F.lit(1)).alias("n_bad")), "fold_id", "left"
    ).select("fold_id", "n_days", F.coalesce("n_bad", F.lit(0)).cast("bigint").alias("n_bad"))


@over_panel
def f10_holdout(p: Panel) -> DataFrame:
    out = folds.holdout(p.df, (20240101, 20240120), (20240122, 20240130), "review")
    return present(out, ["midpx"], [*KEYS, "holdout_name", "segment"])


@over_panel
def f11_folds_on_bars(p: Panel) -> DataFrame:
    days = folds.fold_days(calendar_of(p), SCALED_PROFILES)
    attached = folds.attach_folds(p.df, days)
    return present(
        attached.groupBy("profile", "fold_id", "segment").agg(
            F.count(F.lit(1)).alias("n_rows"), F.avg(LABEL).alias("label_mean")
        ),
        ["label_mean"],
        ["profile", "fold_id", "segment", "n_rows"],
    )


# -- labels -----------------------------------------------------------------------


@over_panel
def g01_target_modes(p: Panel) -> DataFrame:
    rows = bars.keys_and_label(p)
    for mode in labels.TARGET_MODES:
        rows = labels.with_target(p, rows, mode, f"y_{mode}")
    return present(rows, [f"y_{m}" for m in labels.TARGET_MODES], KEYS)


@over_panel
def g02_interval_baseline(p: Panel) -> DataFrame:
    split = 20240120
    train = bars.keys_and_label(p).where(F.col("date") <= split)
    scored = member_a(p).where(F.col("date") > split)
    return present(labels.add_baseline_back(scored, labels.interval_baseline(train)), ["pred"], KEYS)


@over_panel
def g03_winsorized_labels(p: Panel) -> DataFrame:
    days = folds.fold_days(calendar_of(p), SCALED_PROFILES[:1]).where(F.col("segment") == "train")
    train = folds.attach_folds(bars.keys_and_label(p), days).withColumn("target", F.col(LABEL))
    limits = {"low_bound": labels.WINSORIZE[0], "high_bound": labels.WINSORIZE[1]}
    bounds = labels.fold_bounds(bars.keys_and_label(p), days, ["fold_id"], limits)
    clipped = train.join(bounds, "fold_id").withColumn("target", labels.winsorized("target"))
    return present(clipped, ["target"], ["fold_id", *KEYS])


@over_panel
def g04_common_targets(p: Panel) -> DataFrame:
    return present(labels.common_targets(bars.keys_and_label(p)), ["fret12_common"], ["date", "bar"])


@over_panel
def g05_common_features(p: Panel) -> DataFrame:
    wanted = ["spread", "obi0", "obi4", "trade_imb", "trade_turnover_imb", "cxl_imb", "trade_activity",
              "order_pressure", "mid_ret1_raw", "regime_score", "state_vol_cs", "state_spread_cs",
              "state_activity_cs"]
    return present(labels.common_features(CATALOGUE.with_stages(p, ["regime"])), wanted, ["date", "bar"])


@over_panel
def g06_sampled_rows(p: Panel) -> DataFrame:
    return present(labels.sample_rows(bars.keys_and_label(p), 0.33, 42, "lgbm"), [LABEL], KEYS)


@over_panel
def g07_regime_state(p: Panel) -> DataFrame:
    out = CATALOGUE.with_stages(p, ["regime"])
    return out.select(*KEYS, labels.regime_state().cast("bigint").alias("state"))


# -- sequences --------------------------------------------------------------------

WINDOW = 6
SEQUENCE_CHANNELS = ["midpx", "bsize0", "buyVwad"]


@over_panel
def i01_window_ends(p: Panel) -> DataFrame:
    return sequences.window_ends(p, WINDOW).select(*KEYS)


@over_panel
def i02_windows(p: Panel) -> DataFrame:
    out = sequences.gather_windows(p, p.df, SEQUENCE_CHANNELS, WINDOW)
    cells = {
        f"x{t}_{c}": F.col("x")[t][i] for t in range(WINDOW) for i, c in enumerate(SEQUENCE_CHANNELS)
    }
    return present(out.withColumns(cells), [*cells, "label"], KEYS)


@over_panel
def i03_window_labels(p: Panel) -> DataFrame:
    return present(sequences.window_labels(p, WINDOW), ["label"], KEYS)


@over_panel
def i04_normalized_channels(p: Panel) -> DataFrame:
    split = 20240120
    norm = sequences.Normalizer(SEQUENCE_CHANNELS).fit(p.df.where(F.col("date") <= split))
    return present(norm.transform(p.df), SEQUENCE_CHANNELS, KEYS)


@over_panel
def i05_snapshots(p: Panel) -> DataFrame:
    shots = sequences.snapshots(p, sequences.window_ends(p, WINDOW), ["midpx"])
    members = F.array_join(F.transform("members", lambda m: m["symbol"].cast("string")), ",")
    total = F.aggregate("members", F.lit(0.0), lambda s, m: s + m["midpx"])
    out = shots.select("date", "bar", "page", "size", members.alias("symbols"), total.alias("mid_sum"))
    return present(out, ["mid_sum"], ["date", "bar", "page", "size", "symbols"])


@over_panel
def i06_snapshot_order(p: Panel) -> DataFrame:
    out = sequences.flat_order(p, sequences.window_ends(p, WINDOW))
    return out.select(*KEYS, "snapshot", "slot", "size")


@over_panel
def i07_padded_batches(p: Panel) -> DataFrame:
    out = sequences.padded_batches(p, sequences.window_ends(p, WINDOW), ["midpx"], 16)
    tall = out.select(
        "batch", "date", "bar", "page", F.posexplode(F.arrays_zip("symbols", "midpx", "mask")).alias("i", "m")
    )
    tall = tall.withColumn("slot", F.col("page") * F.lit(p.limits.page_members) + F.col("i"))
    cells = tall.select(
        "batch", "date", "bar", F.col("slot").cast("bigint").alias("slot"), F.col("m.symbols").alias("symbol"),
        F.col("m.midpx").alias("midpx"), F.col("m.mask").cast("bigint").alias("present"),
    )
    return present(cells, ["midpx"], ["batch", "date", "bar", "slot", "symbol", "present"])


@over_panel
def i08_snapshot_zscores(p: Panel) -> DataFrame:
    out = sequences.snapshot_zscores(p, p.df, ["bsize0", "tradeBuyQty"])
    return present(out, ["bsize0_sz", "tradeBuyQty_sz"], KEYS)


@over_panel
def i09_flat_vectors(p: Panel) -> DataFrame:
    out = sequences.flat_vectors(p.df, SEQUENCE_CHANNELS)
    cells = {f"x_{c}": F.col("x")[i] for i, c in enumerate(SEQUENCE_CHANNELS)}
    return present(out.withColumns(cells), [*cells, "label"], KEYS)


@over_panel
def i10_only_dates(p: Panel) -> DataFrame:
    dates = weekday_calendar(p).select(F.col("day").alias("date"))
    return present(sequences.only_dates(bars.keys_and_label(p), dates), [LABEL], KEYS)


# -- metrics ----------------------------------------------------------------------


def _fold_metrics(p: Panel) -> DataFrame:
    return fold_metrics(tall_members(p), folds.fold_days(calendar_of(p), SCALED_PROFILES))


def _fold_of(p: Panel) -> DataFrame:
    """Predictions of the two members on the validation days of the short profile."""
    days = folds.fold_days(calendar_of(p), SCALED_PROFILES[:1]).where(F.col("segment") == "val")
    return both_members(p).join(days.select("date", "fold_id"), "date")


@over_panel
def j01_pooled_scores(p: Panel) -> DataFrame:
    out = tall_members(p).groupBy("experiment_id").agg(*metrics.pooled())
    return present(out, ["mse", "corr", "r2"], ["experiment_id"])


@over_panel
def j02_submission_scores(p: Panel) -> DataFrame:
    out = tall_members(p).groupBy("experiment_id").agg(*metrics.submission())
    return present(out, ["pearson", "r2", "mse"], ["experiment_id"])


@over_panel
def j03_daily_ic(p: Panel) -> DataFrame:
    out = metrics.daily_ic(tall_members(p), ["experiment_id"])
    return present(
        out, ["daily_corr_mean", "daily_corr_std", "daily_corr_min"], ["experiment_id", "n_days", "n_scored_days"]
    )


LENS = ["pooled_corr", "fold_corr_mean", "fold_corr_std", "fold_corr_min", "fold_positive_rate",
        "stability_score", "daily_ic_mean", "daily_ic_std", "daily_ic_ir"]


@over_panel
def j04_lenses(p: Panel) -> DataFrame:
    return present(metrics.lenses(_fold_of(p), "pred_a"), LENS, ["n_folds", "n_rows"])


@over_panel
def j05_snapshot_ic(p: Panel) -> DataFrame:
    return present(metrics.snapshot_ic(member_a(p)), ["snapshot_ic"], ["n_snapshots"])


@over_panel
def j06_objective(p: Panel) -> DataFrame:
    rows = member_a(p)
    pooled = metrics.objective(rows, 0.5, False).withColumn("kind", F.lit("pooled"))
    snap = metrics.objective(rows, 0.5, True).withColumn("kind", F.lit("snapshot"))
    return present(pooled.unionByName(snap), ["mse", "corr", "objective"], ["kind"])


@over_panel
def j07_robust_pearson(p: Panel) -> DataFrame:
    out = tall_members(p).groupBy("experiment_id", "date").agg(
        metrics.robust_pearson(F.col("pred"), F.col("label")).alias("corr")
    )
    return present(out, ["corr"], ["experiment_id", "date"])


@over_panel
def j08_train_val_gap(p: Panel) -> DataFrame:
    return present(metrics.corr_gap(_fold_metrics(p)), ["train_val_corr_gap"], ["profile", "fold_id", "experiment_id"])


@over_panel
def j09_fold_summary(p: Panel) -> DataFrame:
    out = metrics.summarize_folds(_fold_metrics(p), ["profile", "experiment_id"])
    return present(out, ["mean", "std", "min", "max", "positive_rate"], ["profile", "experiment_id", "n_folds"])


SUMMARY = ["rolling_corr_mean", "rolling_corr_std", "rolling_corr_min", "rolling_corr_median", "positive_fold_rate",
           "stability_score", "rolling_mse_mean", "rolling_mse_std", "rolling_r2_mean", "rolling_r2_min",
           "daily_corr_mean", "daily_corr_std", "train_val_corr_gap_mean", "runtime_sec_sum"]


def _fold_table(p: Panel) -> DataFrame:
    """Fold metrics as a written table: what follows reads them, not the bars."""
    return written(_fold_metrics(p), "fold_metrics")


def _summary(p: Panel) -> DataFrame:
    return leaderboard.summarize_profiles(
        _fold_table(p).withColumn("runtime_sec", F.col("n_val_rows").cast("double"))
    )


@over_panel
def j10_profile_summary(p: Panel) -> DataFrame:
    return present(_summary(p), SUMMARY, ["profile", "experiment_id", "n_folds"])


PROTOCOL = ["protocol_corr_mean", "protocol_stability_score", "protocol_corr_min", "protocol_mse_mean",
            "protocol_r2_mean", "protocol_positive_fold_rate", "protocol_daily_ic_mean", "protocol_daily_ic_ir"]


@over_panel
def j11_protocol_scores(p: Panel) -> DataFrame:
    return present(leaderboard.protocol_scores(_summary(p), SCALED_WEIGHTS), PROTOCOL, ["experiment_id"])


PREFIXED = [f"{x}_{m}" for x in ("short", "medium", "long", "expanding")
            for m in ("corr_mean", "corr_std", "corr_min", "stability_score", "positive_fold_rate",
                      "daily_corr_mean", "daily_corr_std", "daily_ic_ir")]


@over_panel
def j12_leaderboard(p: Panel) -> DataFrame:
    board = leaderboard.build_leaderboard(_summary(p), BASELINE, SCALED_WEIGHTS)
    deltas = ["baseline_delta_corr", "baseline_delta_stability", "baseline_delta_mse_pct", "baseline_delta_r2"]
    counts = [f"{x}_n_folds" for x in ("short", "medium", "long", "expanding")]
    return present(board, [*PROTOCOL, *PREFIXED, *deltas], ["experiment_id", *counts])


@over_panel
def j13_verdicts(p: Panel) -> DataFrame:
    summary = _summary(p)
    board = leaderboard.build_leaderboard(summary, BASELINE, SCALED_WEIGHTS)
    other = leaderboard.build_leaderboard(summary, "X1_book", SCALED_WEIGHTS)
    columns = ["experiment_id", "decision", "failed_gates"]
    return board.select(F.lit(BASELINE).alias("against"), *columns).unionByName(
        other.select(F.lit("X1_book").alias("against"), *columns)
    )


@over_panel
def j14_paired_diagnosis(p: Panel) -> DataFrame:
    out = leaderboard.paired_diagnosis(_fold_table(p), BASELINE)
    return present(
        out,
        ["delta_mean", "delta_se", "t_stat", "delta_gap", "delta_daily_ic", "delta_corr_min"],
        ["profile", "experiment_id", "n_folds", "n_up", "n_down"],
    )


def _joined(p: Panel) -> DataFrame:
    """Both members where the second one scored."""
    a, b = member_a(p), member_b(p)
    return a.withColumnRenamed("pred", "pred_a").join(b.select(*KEYS, F.col("pred").alias("pred_b")), KEYS)


@over_panel
def j15_member_correlation(p: Panel) -> DataFrame:
    columns = ["pred_a", "pred_b", "label"]
    moments = blend.moments_by_date(_joined(p), columns)
    overall = blend.merged_moments(moments, columns)
    z = {c: F.col(f"_s.{c}") * F.lit(0.5) for c in columns[:2]}
    pairs = {
        "a_b": ({"pred_a": 1.0}, {"pred_b": 1.0}), "a_label": ({"pred_a": 1.0}, {"label": 1.0}),
        "b_label": ({"pred_b": 1.0}, {"label": 1.0}), "z_label": (z, {"label": 1.0}),
        "raw_label": ({"pred_a": 0.5, "pred_b": 0.5}, {"label": 1.0}),
    }
    scored = F.inline(
        F.array(*[F.struct(F.lit(n).alias("pair"), blend.mix_correlation(x, y, columns).alias("ic")) for n, (x, y) in pairs.items()])
    )
    scales = blend.z_scales(overall, columns[:2])
    daily = metrics.summarized_ic(moments.withColumn("_s", scales).select("date", "n", scored), ["pair"])
    out = overall.withColumn("_s", scales).select(scored).withColumnRenamed("ic", "overall").join(daily, "pair")
    return present(out, ["overall", "daily_corr_mean", "daily_corr_std", "daily_corr_min"], ["pair", "n_days"])


@over_panel
def j16_best_linear_corr(p: Panel) -> DataFrame:
    out = _joined(p).groupBy("date").agg(
        metrics.correlation(F.col("pred_a"), F.col("label")).alias("i1"),
        metrics.correlation(F.col("pred_b"), F.col("label")).alias("i2"),
        metrics.correlation(F.col("pred_a"), F.col("pred_b")).alias("rho"),
    )
    best = metrics.best_linear_corr(F.col("i1"), F.col("i2"), F.col("rho"))
    return present(out.withColumn("best", best), ["i1", "i2", "rho", "best"], ["date"])


@over_panel
def j17_label_agreement(p: Panel) -> DataFrame:
    return present(metrics.label_agreement(member_a(p), member_b(p), KEYS), ["label_max_abs_diff"], ["n_join"])


@over_panel
def j18_feature_health(p: Panel) -> DataFrame:
    out = metrics.feature_health(p.df, CHANNELS)
    return present(out, ["max_abs"], ["date", "feature", "n_rows", F.col("n_bad").cast("bigint").alias("n_bad")])


# -- blends -----------------------------------------------------------------------


@over_panel
def k01_raw_mean(p: Panel) -> DataFrame:
    rows = member_a(p).unionByName(member_b(p))
    return present(blend.average_members(rows), ["pred"], [*KEYS, "n_members"])


@over_panel
def k02_daily_zscore_mean(p: Panel) -> DataFrame:
    return present(blend.daily_zscore_mean(both_members(p), ["pred_a", "pred_b"]), ["pred"], KEYS)


@over_panel
def k03_weighted_blend(p: Panel) -> DataFrame:
    weights = {"pred_a": 1.0, "pred_b": 3.0}
    df = _joined(p)
    for mode in ("raw", "zscore", "rank"):
        df = blend.weighted_blend(df, weights, mode, p.total_fits).withColumnRenamed("pred_blend", f"blend_{mode}")
        df = df.drop("pred_a_z", "pred_b_z")
    return present(df, ["blend_raw", "blend_zscore", "blend_rank"], KEYS)


@over_panel
def k04_fallback_fusion(p: Panel) -> DataFrame:
    second = member_b(p).select(*KEYS, F.col("pred").alias("pred_dl"))
    return present(blend.fuse(member_a(p), second), ["fused"], KEYS)


@over_panel
def k05_clipped_predictions(p: Panel) -> DataFrame:
    return present(blend.clipped(member_a(p), 0.01, fits_task=p.total_fits), ["pred"], KEYS)


@over_panel
def k06_normalized_forms(p: Panel) -> DataFrame:
    out = blend.normalized_forms(p, member_b(p))
    return present(out, ["pred_rank_scaled", "pred_group_demean"], KEYS)


@over_panel
def k07_postprocess_grid(p: Panel) -> DataFrame:
    return present(
        blend.postprocess_grid(p, member_b(p)), ["clip_q", "blend_alpha", "corr", "mse", "r2"], ["name", "blend_kind"]
    )


@over_panel
def k08_weight_sweep(p: Panel) -> DataFrame:
    moments = blend.moments_by_date(_joined(p), ["pred_a", "pred_b", "label"])
    return present(blend.weight_sweeps(moments, "pred_a", "pred_b"), ["weight", "corr", "daily_ic_mean"])


@over_panel
def k09_blend_report(p: Panel) -> DataFrame:
    out = blend.blend_report(_joined(p), "pred_a", "pred_b")
    return present(out, [c for c in out.columns if c != "n_join"], ["n_join"])


