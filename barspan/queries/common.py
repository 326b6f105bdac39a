"""Inputs shared by the registered queries: panel, calendar, test predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barspan.functions.scalars import KEYS, LABEL, presented
from barspan.operators.folds import Profile
from barspan.operators.sequences import window_ends
from barspan.sources.bars import Panel, panel_from_events
from barspan.sources.calendar import calendar_table, weekdays

Query = Callable[[SparkSession, str], DataFrame]

# The panel spans 30 days, so the 40-day profiles are scaled down to 12.
SCALED_PROFILES = [
    Profile("short_8d_2d", val_days=2, step=5, train_days=8, min_train_days=8),
    Profile("medium_20d_5d", val_days=5, step=5, train_days=20, min_train_days=20),
    Profile("long_12d_3d", val_days=3, step=6, train_days=12, min_train_days=12),
    Profile("expanding_12d_3d", val_days=3, step=3, mode="expanding", min_train_days=12),
]
SCALED_WEIGHTS = {"short_8d_2d": 0.25, "medium_20d_5d": 0.35, "long_12d_3d": 0.25, "expanding_12d_3d": 0.15}
BASELINE = "R02_ridge_legacy_plus_norm_core"
WARMUP = 8


def panel_of(spark: SparkSession, sf_dir: str) -> Panel:
    return panel_from_events(spark, sf_dir)


def days_of(panel: Panel) -> DataFrame:
    return panel.df.select(F.col("date").alias("day")).distinct()


def calendar_of(panel: Panel) -> DataFrame:
    """Every day of the panel counts as a trading day."""
    return calendar_table(days_of(panel))


def weekday_calendar(panel: Panel) -> DataFrame:
    """Weekends are no trading days, so calendar lookups have something to skip."""
    return calendar_table(weekdays(days_of(panel)))


def dates_of(panel: Panel) -> DataFrame:
    return panel.df.select("date").distinct()


def present(df: DataFrame, numbers: Iterable[str], keys: Iterable[str] = ()) -> DataFrame:
    return df.select(*keys, *[presented(c) for c in numbers])


def pred_a() -> Column:
    return F.col("midpx") / F.col("open") - F.lit(1.0)


def pred_b() -> Column:
    size = F.col("bsize0") + F.col("asize0")
    return (F.col("bsize0") - F.col("asize0")) / size / F.lit(1000.0)


def member_a(panel: Panel) -> DataFrame:
    return panel.df.select(*KEYS, F.col(LABEL).alias("label"), pred_a().alias("pred"))


def member_b(panel: Panel) -> DataFrame:
    """The second member needs a full window of 8 bars, so it warms up."""
    ends = window_ends(panel, WARMUP)
    return ends.select(*KEYS, F.col(LABEL).alias("label"), pred_b().alias("pred"))


def tall_members(panel: Panel) -> DataFrame:
    """experiment_id, keys, label, pred: the two members and their mean."""
    df = panel.df.select(*KEYS, F.col(LABEL).alias("label"), pred_a().alias("a"), pred_b().alias("b"))
    mean = (F.col("a") + F.col("b")) / F.lit(2.0)
    members = {BASELINE: F.col("a"), "X1_book": F.col("b"), "X2_mean": mean}
    rows = F.array(*[F.struct(F.lit(n).alias("experiment_id"), c.alias("pred")) for n, c in members.items()])
    return df.select(*KEYS, "label", F.inline(rows))


def both_members(panel: Panel) -> DataFrame:
    """keys, label, pred_a, pred_b on all bars."""
    return panel.df.select(*KEYS, F.col(LABEL).alias("label"), pred_a().alias("pred_a"), pred_b().alias("pred_b"))
