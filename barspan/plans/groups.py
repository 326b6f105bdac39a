"""Group statistics attached to rows: cross-sections and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barspan.plans.tables import written

CROSS = ["date", "bar"]


def attach(df: DataFrame, groups: list[str], statistics: dict[str, Column], cut: bool = False) -> DataFrame:
    """Aggregate per group and join the result back.

    The aggregation combines on the map side, so a hot group costs one row per
    task; the join leaves the choice of strategy, and the splitting of a skewed
    key, to adaptive execution. ``cut`` continues from a written table.
    """
    if cut:
        df = written(df, "rows")
    table = df.groupBy(*groups).agg(*[c.alias(n) for n, c in statistics.items()])
    return df.join(table, groups)


def attach_bounded(
    df: DataFrame, fits_task: bool, groups: list[str], statistics: dict[str, Column]
) -> DataFrame:
    """One window pass while the measured groups fit a task, ``attach`` beyond."""
    if not fits_task:
        return attach(df, groups, statistics, cut=True)
    window = Window.partitionBy(*groups)
    return df.withColumns({n: c.over(window) for n, c in statistics.items()})


def cross_zscores(df: DataFrame, fits_task: bool, columns: dict[str, str]) -> DataFrame:
    """(x - mean) / sample std per cross-section; 0 where the column is constant.

    ``columns`` maps the new column to its source.
    """
    statistics: dict[str, Column] = {}
    for name, c in columns.items():
        statistics[f"_m_{name}"] = F.avg(c)
        statistics[f"_s_{name}"] = F.stddev_samp(c)
        statistics[f"_lo_{name}"] = F.min(c)
        statistics[f"_hi_{name}"] = F.max(c)
    df = attach_bounded(df, fits_task, CROSS, statistics)
    scores = {
        name: F.when(F.col(f"_lo_{name}") == F.col(f"_hi_{name}"), F.lit(0.0)).otherwise(
            F.try_divide(F.col(c) - F.col(f"_m_{name}"), F.col(f"_s_{name}"))
        )
        for name, c in columns.items()
    }
    return df.withColumns(scores).drop(*statistics)
