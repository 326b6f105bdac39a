"""Measured shape of a panel, and what one task may hold.

Window functions put a whole window partition into one task. A series or a
cross-section is normally a few hundred rows, but nothing in the input promises
it, so the sizes are measured once per panel with a two-column aggregation and
every operator picks between a plain window and a form that splits large groups.
Both forms return the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Limits:
    """Largest group a single task is given, the split sizes beyond it, and rows of a task that holds many groups."""

    series_rows: int = 200_000
    cross_rows: int = 200_000
    date_rows: int = 500_000
    chunk_rows: int = 50_000
    page_members: int = 4_096
    task_rows: int = 50_000


@dataclass(frozen=True)
class Layout:
    """Largest (date, symbol) series, (date, bar) cross-section and date; all rows."""

    series_rows: int
    cross_rows: int
    date_rows: int
    total_rows: int


def dealt(df: DataFrame, layout: Layout, limits: Limits, keys: list[str]) -> DataFrame:
    """Groups dealt over as many tasks as their rows need, for a chain of windows over them.

    Every sort of such a chain keeps its task's rows. Left to itself, adaptive execution packs shuffled
    groups by their compressed size into about one task a core, whose rows grow with the table.
    """
    if layout.total_rows <= limits.task_rows:
        return df
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-layout.total_rows // limits.task_rows))
    return df.repartition(tasks, *keys)


def measure(keys: DataFrame) -> Layout:
    """Measure from the columns date and symbol.

    A bar key occurs once per symbol, so the number of symbols of a date bounds
    its cross-sections; all maxima then come from one aggregation whose input
    shrinks to one row per series before any shuffle.
    """
    per_series = keys.groupBy("date", "symbol").agg(F.count(F.lit(1)).alias("n"))
    n, one = F.col("n"), F.lit(1)
    per_date = per_series.groupBy("date").agg(
        F.max(n).alias("longest"), F.sum(n).alias("rows"), F.count(one).alias("members")
    )
    whole = per_date.agg(
        *[F.max(c).alias(c) for c in ("longest", "rows", "members")], F.sum("rows").alias("total")
    ).first()
    return Layout(*[int(whole[c] or 0) for c in ("longest", "members", "rows", "total")])
