"""Scores of predictions. Inputs carry ``label`` and ``pred`` next to their keys;
every score is one or two aggregations with map-side partials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barspan.functions.scalars import FLAT_STD, R2_EPS, clean, pearson, zero
from barspan.plans.groups import CROSS


def correlation(x: Column, y: Column) -> Column:
    """Pearson, null when a side is constant."""
    varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def correlation_or_zero(x: Column, y: Column) -> Column:
    """Pearson with 0 for a constant side or fewer than two rows."""
    return F.coalesce(correlation(x, y), F.lit(0.0))


def pooled(pred: str = "pred", label: str = "label") -> list[Column]:
    """Aggregates mse, corr, r2 with the population variance in R2."""
    p, y = clean(F.col(pred)), F.col(label)
    sse = F.sum((p - y) * (p - y))
    return [
        F.avg((p - y) * (p - y)).alias("mse"),
        correlation_or_zero(p, y).alias("corr"),
        (F.lit(1.0) - sse / (F.var_pop(y) * F.count(y) + F.lit(R2_EPS))).alias("r2"),
    ]


def submission(pred: str = "pred", label: str = "label") -> list[Column]:
    """Aggregates pearson, r2 (sample variance) and mse, nulls counted as 0."""
    p, y = clean(F.col(pred)), clean(F.col(label))
    sse, n, variance = F.sum((p - y) * (p - y)), F.count(F.lit(1)), F.var_samp(y)
    return [
        correlation(p, y).alias("pearson"),
        (F.lit(1.0) - F.try_divide(F.try_divide(sse, F.when(variance > 0, variance)), n)).alias("r2"),
        F.try_divide(sse, n).alias("mse"),
    ]


def group_correlation(df: DataFrame, groups: list[str], pred: str = "pred", label: str = "label") -> DataFrame:
    return df.groupBy(*groups).agg(
        correlation(clean(F.col(pred)), F.col(label)).alias("ic"), F.count(F.lit(1)).alias("n_rows")
    )


def daily_ic(df: DataFrame, by: list[str] | None = None, pred: str = "pred", label: str = "label") -> DataFrame:
    """Mean, population std and minimum of the per-date correlation. Dates whose
    correlation is undefined count in n_days and nowhere else."""
    by = by or []
    return summarized_ic(group_correlation(df, [*by, "date"], pred, label), by)


def summarized_ic(days: DataFrame, by: list[str]) -> DataFrame:
    """The same of correlations ``ic`` that are known per date."""
    grouped = days.groupBy(*by) if by else days
    return grouped.agg(
        zero(F.avg("ic")).alias("daily_corr_mean"),
        zero(F.stddev_pop("ic")).alias("daily_corr_std"),
        zero(F.min("ic")).alias("daily_corr_min"),
        F.count(F.lit(1)).alias("n_days"),
        F.count("ic").alias("n_scored_days"),
    )


def bundle(df: DataFrame, by: list[str], pred: str = "pred", label: str = "label") -> DataFrame:
    """Pooled and daily scores per group, joined on the group."""
    return (
        df.groupBy(*by).agg(*pooled(pred, label)).join(daily_ic(df, by, pred, label), by)
        if by
        else _side_by_side(df, pred, label)
    )


def _side_by_side(df: DataFrame, pred: str, label: str) -> DataFrame:
    day = daily_ic(df, [], pred, label)
    row = day.select(F.struct(*[F.col(c) for c in day.columns]).alias("d")).scalar()
    return df.agg(*pooled(pred, label)).withColumn("_d", row).select("mse", "corr", "r2", "_d.*")


def lenses(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Pooled, per-fold and per-date correlation of one prediction column.

    One pass computes all three levels as grouping sets; a side with no variance
    scores 0 at every level.
    """
    p, y = F.col(pred), F.col(label)
    level = df.groupingSets([[], ["fold_id"], ["date"]], "fold_id", "date").agg(
        zero(pearson(p, y)).alias("corr"),
        F.count(F.lit(1)).alias("n"),
        F.grouping("fold_id").alias("no_fold"),
        F.grouping("date").alias("no_date"),
    )
    is_fold, is_day = F.col("no_fold") == 0, F.col("no_date") == 0
    at = lambda cond: F.when(cond, F.col("corr"))
    whole = (F.col("no_fold") == 1) & (F.col("no_date") == 1)
    out = level.agg(
        F.max(at(whole)).alias("pooled_corr"),
        F.avg(at(is_fold)).alias("fold_corr_mean"),
        F.stddev_pop(at(is_fold)).alias("fold_corr_std"),
        F.min(at(is_fold)).alias("fold_corr_min"),
        F.avg(F.when(is_fold, F.when(F.col("corr") > 0, 1.0).otherwise(0.0))).alias("fold_positive_rate"),
        F.count(at(is_fold)).alias("n_folds"),
        F.avg(at(is_day)).alias("daily_ic_mean"),
        F.stddev_pop(at(is_day)).alias("daily_ic_std"),
        F.max(F.when(whole, F.col("n"))).alias("n_rows"),
    )
    spread = F.when(F.col("daily_ic_std") > FLAT_STD, F.col("daily_ic_std"))
    return out.withColumns(
        {
            "stability_score": F.col("fold_corr_mean") - F.lit(STABILITY_PENALTY) * F.col("fold_corr_std"),
            "daily_ic_ir": F.try_divide(F.col("daily_ic_mean"), spread),
        }
    )


# Fixed value: weight of the fold spread in the stability score.
STABILITY_PENALTY = 0.7


def snapshot_ic(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Mean over (date, bar) of the correlation across members, where there are
    at least two; the product of squared sums is guarded as in the training loss."""
    p, y = clean(F.col(pred)), F.col(label)
    n = F.count(F.lit(1)).cast("double")
    cov, vp, vy = F.covar_pop(p, y) * n, F.var_pop(p) * n, F.var_pop(y) * n
    per = df.groupBy(*CROSS).agg(
        (cov / F.sqrt(vp * vy + F.lit(R2_EPS))).alias("ic"), F.count(F.lit(1)).alias("n")
    )
    return per.where(F.col("n") >= 2).agg(
        zero(F.avg("ic")).alias("snapshot_ic"), F.count(F.lit(1)).alias("n_snapshots")
    )


def robust_pearson(x: Column, y: Column, eps: float = R2_EPS) -> Column:
    """covariance sum / sqrt(product of squared sums), 0 when that root is below eps."""
    n = F.count(F.lit(1)).cast("double")
    root = F.sqrt(F.var_pop(x) * n * F.var_pop(y) * n)
    return F.when((n >= 2) & (root >= eps), F.try_divide(F.covar_pop(x, y) * n, root)).otherwise(F.lit(0.0))


def objective(df: DataFrame, weight: float, per_snapshot: bool, pred: str = "pred", label: str = "label") -> DataFrame:
    """mse + weight (1 - corr), the correlation pooled or averaged over snapshots."""
    p, y = F.col(pred), F.col(label)
    mse = F.avg((p - y) * (p - y))
    if per_snapshot:
        ic = snapshot_ic(df, pred, label).select("snapshot_ic").scalar()
        out = df.agg(mse.alias("mse")).withColumn("corr", ic)
    else:
        n = F.count(F.lit(1)).cast("double")
        root = F.sqrt(F.var_pop(p) * n * F.var_pop(y) * n + F.lit(R2_EPS))
        out = df.agg(mse.alias("mse"), (F.covar_pop(p, y) * n / root).alias("corr"))
    return out.withColumn("objective", F.col("mse") + F.lit(weight) * (F.lit(1.0) - F.col("corr")))


def summarize_folds(metrics: DataFrame, by: list[str], key: str = "val_corr") -> DataFrame:
    """Mean, std, worst, best, count and positive rate of a fold metric."""
    v = F.when(F.abs(F.col(key)) < F.lit(float("inf")), F.col(key))
    return metrics.groupBy(*by).agg(
        zero(F.avg(v)).alias("mean"),
        zero(F.stddev_pop(v)).alias("std"),
        zero(F.min(v)).alias("min"),
        zero(F.max(v)).alias("max"),
        F.count(v).alias("n_folds"),
        zero(F.avg(F.when(v > 0, 1.0).when(v <= 0, 0.0))).alias("positive_rate"),
    )


def corr_gap(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("train_val_corr_gap", F.col("train_corr") - F.col("val_corr"))


def best_linear_corr(i1: Column, i2: Column, rho: Column) -> Column:
    """Upper bound of the correlation of a linear mix of two signals."""
    spare = F.lit(1.0) - rho * rho
    value = F.try_divide(i1 * i1 + i2 * i2 - F.lit(2.0) * rho * i1 * i2, F.when(spare > 1e-12, spare))
    return F.when(value > 0, F.sqrt(value))


def label_agreement(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Largest absolute label difference of two prediction sources."""
    both = left.select(*keys, F.col("label").alias("_a")).join(
        right.select(*keys, F.col("label").alias("_b")), keys
    )
    return both.agg(
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("label_max_abs_diff"), F.count(F.lit(1)).alias("n_join")
    )


def feature_health(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per date and column: cells that are null or not finite, largest magnitude."""
    bad = lambda c: F.sum(F.when(F.abs(F.col(c)) < F.lit(float("inf")), 0).otherwise(1))
    size = lambda c: F.max(F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.abs(F.col(c))))
    wide = df.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[bad(c).alias(f"bad_{c}") for c in columns],
        *[size(c).alias(f"max_{c}") for c in columns],
    )
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"bad_{c}").alias("n_bad"), F.col(f"max_{c}").alias("max_abs"))
            for c in columns
        ]
    )
    return wide.select("date", "n_rows", F.inline(cells))
