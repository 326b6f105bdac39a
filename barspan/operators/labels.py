"""Training targets and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barspan.functions.scalars import KEYS, LABEL, clean
from barspan.plans.groups import attach, attach_bounded
from barspan.plans.order_stats import quantiles, smallest_rows, value_bucket
from barspan.plans.tables import written
from barspan.sources.bars import Panel

TARGET_MODES = ("raw", "date_demean", "interval_demean", "interval_residual")
# Default winsorizing quantiles.
WINSORIZE = (0.01, 0.99)
COMMON_FEATURES = [
    "spread", "obi0", "obi4", "trade_imb", "trade_turnover_imb", "cxl_imb", "trade_activity",
    "order_pressure", "mid_ret1_raw", "regime_score", "state_vol_cs", "state_spread_cs",
    "state_activity_cs", "interval_pos", "interval_norm", "is_morning", "is_afternoon",
]
SAMPLED_MODELS = {"tree", "tree_big", "tree_shallow", "histgb", "histgb_shallow", "gbdt", "lgbm"}


def interval_baseline(rows: DataFrame) -> DataFrame:
    """Mean training label per bar of the day: at most one row per clock time."""
    return rows.groupBy("bar").agg(F.avg(LABEL).alias("interval_mean"))


def attach_baseline(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    out = rows.join(baseline, "bar", "left")
    return out.withColumn("interval_mean", F.coalesce("interval_mean", F.lit(0.0)))


def with_target(
    panel: Panel, rows: DataFrame, mode: str, name: str = "target", train: DataFrame | None = None
) -> DataFrame:
    """Add the training target; ``train`` are the rows the baseline is fitted on."""
    y = F.col(LABEL)
    if mode == "raw":
        return rows.withColumn(name, y)
    if mode == "date_demean":
        return attach(rows, ["date"], {"_mean": F.avg(LABEL)}).withColumn(name, y - F.col("_mean")).drop("_mean")
    if mode == "interval_demean":
        out = attach_bounded(rows, panel.cross_fits, ["date", "bar"], {"_mean": F.avg(LABEL)})
        return out.withColumn(name, y - F.col("_mean")).drop("_mean")
    if mode == "interval_residual":
        out = attach_baseline(rows, interval_baseline(rows if train is None else train))
        return out.withColumn(name, y - F.col("interval_mean")).drop("interval_mean")
    raise ValueError(f"unknown target mode {mode!r}")


def add_baseline_back(predictions: DataFrame, baseline: DataFrame) -> DataFrame:
    out = attach_baseline(predictions, baseline)
    return out.withColumn("pred", F.col("pred") + F.col("interval_mean")).drop("interval_mean")


def check_quantiles(low: float, high: float) -> tuple[float, float]:
    if not 0.0 <= low < high <= 1.0:
        raise ValueError("winsorizing needs 0 <= low < high <= 1")
    return low, high


def winsor_bounds(
    rows: DataFrame,
    target: str,
    groups: list[str],
    low: float = WINSORIZE[0],
    high: float = WINSORIZE[1],
    fits_task: bool = False,
) -> DataFrame:
    """Exact clip bounds per group, one row each."""
    check_quantiles(low, high)
    return quantiles(rows, groups, target, {"low_bound": low, "high_bound": high}, fits_task)


def fold_bounds(rows: DataFrame, days: DataFrame, by: list[str], quantile: dict[str, float], target: str = LABEL) -> DataFrame:
    """Exact quantiles of ``target`` over the dates of every fold, one row per ``by``; bars aren't copied per fold.

    ``days`` lists the dates of each fold (``by`` and date). Values are counted once per date. Folds overlap, so
    each adds up its dates' counts per bucket (the leading bits of a value) and finds the buckets that hold the
    wanted positions; only the values of those few buckets are laid out per fold.
    """
    n_values, run = F.sum("n_equal"), Window.partitionBy(*by).orderBy("_high")
    seen = rows.where(F.col(target).isNotNull()).select("date", F.col(target).cast("double").alias("value"))
    counts = seen.groupBy("date", "value").agg(F.count(F.lit(1)).alias("n_equal"))
    counts = written(counts.withColumn("_high", value_bucket(F.col("value"))), "date_counts")
    buckets = counts.groupBy("date", "_high").agg(n_values.alias("n_equal")).join(days.select(*by, "date"), "date")
    buckets = buckets.groupBy(*by, "_high").agg(n_values.alias("held"))
    buckets = buckets.withColumn("through", F.sum("held").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    sized = buckets.withColumn("n", F.sum("held").over(Window.partitionBy(*by)))
    at = [F.lit(q) * (F.col("n") - F.lit(1)).cast("double") for q in quantile.values()]
    first, last = F.col("through") - F.col("held"), F.col("through") - F.lit(1)
    holds = F.lit(False)
    for p in at:
        holds = holds | ((first <= F.ceil(p)) & (last >= F.floor(p)))
    needed = sized.where(holds).select(*by, "_high", "n", first.alias("_before"))
    inside = counts.join(needed.join(days.select(*by, "date"), by), ["date", "_high"])
    values = inside.groupBy(*by, "_high", "n", "_before", "value").agg(n_values.alias("n_equal"))
    ordered = Window.partitionBy(*by, "_high").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_last", F.col("_before") + F.sum("n_equal").over(ordered) - F.lit(1))
    begin = F.col("_last") - F.col("n_equal") + F.lit(1)
    pick = lambda p: F.max(F.when((begin <= p) & (F.col("_last") >= p), F.col("value")))
    found = values.groupBy(*by).agg(
        *[pick(F.floor(p)).alias(f"_lo{i}") for i, p in enumerate(at)],
        *[pick(F.ceil(p)).alias(f"_hi{i}") for i, p in enumerate(at)],
        *[F.max(p - F.floor(p)).alias(f"_part{i}") for i, p in enumerate(at)],
    )
    between = lambda i: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}")
    return found.select(*by, *[between(i).alias(name) for i, name in enumerate(quantile)])


def winsorized(target: str) -> Column:
    return F.greatest(F.least(F.col(target), F.col("high_bound")), F.col("low_bound"))


def winsorize(
    rows: DataFrame,
    target: str,
    low: float = WINSORIZE[0],
    high: float = WINSORIZE[1],
    fits_task: bool = False,
) -> DataFrame:
    """Clip the target of training rows; validation rows are never passed in."""
    bounds = winsor_bounds(rows, target, [], low, high, fits_task)
    one = bounds.select(F.struct("low_bound", "high_bound").alias("b")).scalar()
    clipped = F.greatest(F.least(F.col(target), F.col("_b.high_bound")), F.col("_b.low_bound"))
    return rows.withColumn("_b", one).withColumn(target, clipped).drop("_b")


def common_targets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("date", "bar").agg(F.avg(LABEL).alias("fret12_common"))


def common_features(features: DataFrame) -> DataFrame:
    """Cross-section means of the common columns that are present."""
    present = [c for c in COMMON_FEATURES if c in features.columns]
    return features.groupBy("date", "bar").agg(*[F.avg(c).alias(c) for c in present])


def sample_key(seed: int) -> Column:
    """A number in [0, 2**52) drawn from the row key: the same on every run."""
    text = F.concat_ws("-", *[F.col(k).cast("string") for k in KEYS], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")


def sample_rows(rows: DataFrame, share: float | None, seed: int = 42, model: str | None = None) -> DataFrame:
    """Exactly floor(n share) rows without replacement, for tree models only."""
    if share is None or not 0.0 < share < 1.0 or (model is not None and model not in SAMPLED_MODELS):
        return rows
    keyed = written(rows.withColumn("_draw", sample_key(seed)), "drawn")
    n = keyed.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    keep = F.floor(n.cast("double") * F.lit(share))
    return smallest_rows(keyed, "_draw", keep, KEYS).drop("_draw")


def regime_state() -> Column:
    """Index of the largest of the three regime flags, the first one on ties."""
    low, mid, high = F.col("regime_low"), F.col("regime_mid"), F.col("regime_high")
    return (
        F.when((low >= mid) & (low >= high), F.lit(0)).when(mid >= high, F.lit(1)).otherwise(F.lit(2))
    )


def labels(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, clean(F.col(LABEL)).alias(LABEL))
