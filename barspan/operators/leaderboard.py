"""From fold metrics to a ranked leaderboard with a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barspan.functions.scalars import FLAT_STD
from barspan.operators.folds import PROFILE_WEIGHTS
from barspan.operators.metrics import STABILITY_PENALTY

# Baseline id, thresholds of the verdict.
BASELINE_ID = "R02_ridge_legacy_plus_norm_core"
REJECT_BELOW = 0.003
REVIEW_BELOW = 0.005
LONG_TOLERANCE = -0.006
NOT_WORSE = -1e-6
STRONG_NEGATIVE = -0.01
GATED_PROFILES = ("short", "long", "expanding")


def summarize_profiles(metrics: DataFrame) -> DataFrame:
    """One row per (profile, experiment): fold statistics of every metric."""
    c = F.col("val_corr")
    out = metrics.groupBy("profile", "experiment_id").agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg(c).alias("rolling_corr_mean"),
        F.stddev_pop(c).alias("rolling_corr_std"),
        F.min(c).alias("rolling_corr_min"),
        F.median(c).alias("rolling_corr_median"),
        F.avg(F.when(c > 0, 1.0).when(c <= 0, 0.0)).alias("positive_fold_rate"),
        F.avg("val_mse").alias("rolling_mse_mean"),
        F.stddev_pop("val_mse").alias("rolling_mse_std"),
        F.avg("val_r2").alias("rolling_r2_mean"),
        F.min("val_r2").alias("rolling_r2_min"),
        F.avg("daily_corr_mean").alias("daily_corr_mean"),
        F.avg("daily_corr_std").alias("daily_corr_std"),
        F.avg("train_val_corr_gap").alias("train_val_corr_gap_mean"),
        F.sum("runtime_sec").alias("runtime_sec_sum"),
    )
    stability = F.col("rolling_corr_mean") - F.lit(STABILITY_PENALTY) * F.col("rolling_corr_std")
    return out.withColumn("stability_score", stability)


def _weights(weights: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])


def weighted_average(value: str, weight: Column) -> Column:
    """Profile-weighted mean over the profiles that have the value."""
    present = F.when(F.col(value).isNotNull() & (weight > 0), weight)
    return F.try_divide(F.sum(F.col(value) * present), F.sum(present))


def protocol_scores(summary: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    w = F.coalesce(F.try_element_at(_weights(weights or PROFILE_WEIGHTS), F.col("profile")), F.lit(0.0))
    sources = {
        "protocol_corr_mean": "rolling_corr_mean",
        "protocol_stability_score": "stability_score",
        "protocol_corr_min": "rolling_corr_min",
        "protocol_mse_mean": "rolling_mse_mean",
        "protocol_r2_mean": "rolling_r2_mean",
        "protocol_positive_fold_rate": "positive_fold_rate",
        "protocol_daily_ic_mean": "daily_corr_mean",
        "_daily_std": "daily_corr_std",
    }
    out = summary.groupBy("experiment_id").agg(*[weighted_average(s, w).alias(n) for n, s in sources.items()])
    spread = F.when(F.abs("_daily_std") > FLAT_STD, F.col("_daily_std"))
    ratio = F.try_divide(F.col("protocol_daily_ic_mean"), spread)
    return out.withColumn("protocol_daily_ic_ir", ratio).drop("_daily_std")


def profile_columns(summary: DataFrame, prefixes: list[str]) -> DataFrame:
    """One row per experiment with the metrics of each profile side by side."""
    spread = F.when(F.abs("daily_corr_std") > FLAT_STD, F.col("daily_corr_std"))
    tall = summary.withColumns(
        {"prefix": F.split("profile", "_")[0], "daily_ic_ir": F.try_divide(F.col("daily_corr_mean"), spread)}
    )
    metrics = {
        "corr_mean": "rolling_corr_mean", "corr_std": "rolling_corr_std", "corr_min": "rolling_corr_min",
        "stability_score": "stability_score", "n_folds": "n_folds", "positive_fold_rate": "positive_fold_rate",
        "daily_corr_mean": "daily_corr_mean", "daily_corr_std": "daily_corr_std", "daily_ic_ir": "daily_ic_ir",
    }
    return tall.groupBy("experiment_id").pivot("prefix", prefixes).agg(
        *[F.first(c).alias(n) for n, c in metrics.items()]
    )


def build_leaderboard(
    summary: DataFrame,
    baseline_id: str = BASELINE_ID,
    weights: dict[str, float] | None = None,
    prefixes: list[str] | None = None,
    review: DataFrame | None = None,
    final: DataFrame | None = None,
) -> DataFrame:
    """Protocol scores, profile metrics, holdouts, deltas to the baseline, verdict.

    The input is one row per experiment and profile, so everything here is tiny.
    """
    weights = weights or PROFILE_WEIGHTS
    prefixes = prefixes or list(dict.fromkeys(p.split("_")[0] for p in weights))
    board = protocol_scores(summary, weights).join(profile_columns(summary, prefixes), "experiment_id")
    for name, held in (("review", review), ("final", final)):
        if held is not None:
            renamed = held.select(
                "experiment_id", *[F.col(f"holdout_{m}").alias(f"{name}_holdout_{m}") for m in ("corr", "mse", "r2")]
            )
            board = board.join(renamed, "experiment_id", "left")
    base = board.where(F.col("experiment_id") == baseline_id)
    row = base.agg(F.first(F.struct(*[F.col(c) for c in base.columns])).alias("b")).scalar()
    board = board.withColumn("_b", row)
    delta = lambda c: F.col(c) - F.col(f"_b.{c}")
    base_mse = F.col("_b.protocol_mse_mean")
    board = board.withColumns(
        {
            "baseline_delta_corr": delta("protocol_corr_mean"),
            "baseline_delta_stability": delta("protocol_stability_score"),
            "baseline_delta_mse_pct": F.try_divide(
                delta("protocol_mse_mean"), F.when(F.abs(base_mse) > FLAT_STD, F.abs(base_mse))
            ),
            "baseline_delta_r2": delta("protocol_r2_mean"),
            "decision": F.when(F.col("experiment_id") == baseline_id, F.lit("baseline")).otherwise(verdict()),
            "failed_gates": F.when(F.col("experiment_id") == baseline_id, F.lit("")).otherwise(failed_gates()),
        }
    )
    return board.drop("_b").orderBy(F.desc_nulls_last("protocol_corr_mean"), "experiment_id")


def _gates() -> dict[str, Column]:
    """Conditions a candidate with a large enough gain fails by; null means not checked."""
    own, base = (lambda c: F.col(c)), (lambda c: F.col(f"_b.{c}"))
    delta = lambda c: own(c) - base(c)
    gates = {
        "expanding_negative": own("expanding_corr_mean") < 0,
        "short_expanding_not_up": ~F.coalesce(
            (delta("short_corr_mean") > 0) & (delta("expanding_corr_mean") > 0), F.lit(False)
        ),
        "long_down": delta("long_corr_mean") < LONG_TOLERANCE,
        "daily_ic_down": delta("protocol_daily_ic_mean") < NOT_WORSE,
        "stability_down": delta("protocol_stability_score") < NOT_WORSE,
    }
    for p in GATED_PROFILES:
        worst, was = own(f"{p}_corr_min"), base(f"{p}_corr_min")
        gates[f"{p}_negative_fold"] = (worst < STRONG_NEGATIVE) | ((worst < 0) & (was >= 0))
    return {n: F.coalesce(g, F.lit(False)) for n, g in gates.items()}


def failed_gates() -> Column:
    gain = F.col("protocol_corr_mean") - F.col("_b.protocol_corr_mean")
    names = F.array_join(F.array_compact(F.array(*[F.when(g, F.lit(n)) for n, g in _gates().items()])), ",")
    checked = (gain >= REVIEW_BELOW) & F.col("expanding_corr_mean").isNotNull()
    return F.when(checked, names).otherwise(F.lit(""))


def verdict() -> Column:
    """promote / review / reject / unknown for a row next to its baseline ``_b``."""
    gain = F.col("protocol_corr_mean") - F.col("_b.protocol_corr_mean")
    any_failed = F.lit(False)
    for g in _gates().values():
        any_failed = any_failed | g
    return (
        F.when(gain.isNull(), F.lit("unknown"))
        .when(gain < REJECT_BELOW, F.lit("reject"))
        .when(gain < REVIEW_BELOW, F.lit("review"))
        .when(F.col("expanding_corr_mean").isNull(), F.lit("review"))
        .when(any_failed, F.lit("review"))
        .otherwise(F.lit("promote"))
    )


def paired_diagnosis(metrics: DataFrame, baseline_id: str = BASELINE_ID) -> DataFrame:
    """Per profile and candidate: paired fold deltas against the baseline."""
    measured = ["val_corr", "train_val_corr_gap", "daily_corr_mean"]
    base = metrics.where(F.col("experiment_id") == baseline_id).select(
        "profile", "fold_id", *[F.col(c).alias(f"b_{c}") for c in measured]
    )
    base_min = base.groupBy("profile").agg(F.min("b_val_corr").alias("b_min"))
    others = metrics.where(F.col("experiment_id") != baseline_id)
    worst = others.groupBy("profile", "experiment_id").agg(F.min("val_corr").alias("c_min"))
    d = F.col("val_corr") - F.col("b_val_corr")
    paired = others.join(base, ["profile", "fold_id"]).where(d.isNotNull()).groupBy("profile", "experiment_id").agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg(d).alias("delta_mean"),
        F.try_divide(F.stddev_samp(d), F.sqrt(F.count(F.lit(1)))).alias("delta_se"),
        F.count(F.when(d > 0, 1)).alias("n_up"),
        F.count(F.when(d < 0, 1)).alias("n_down"),
        F.avg(F.col("train_val_corr_gap") - F.col("b_train_val_corr_gap")).alias("delta_gap"),
        F.avg(F.col("daily_corr_mean") - F.col("b_daily_corr_mean")).alias("delta_daily_ic"),
    )
    t = F.try_divide(F.col("delta_mean"), F.when(F.col("delta_se") > 0, F.col("delta_se")))
    return (
        paired.join(worst, ["profile", "experiment_id"])
        .join(base_min, "profile")
        .withColumns({"t_stat": t, "delta_corr_min": F.col("c_min") - F.col("b_min")})
        .drop("c_min", "b_min")
    )

