"""Trading calendar: a table (day, pos) of at most a few hundred days per year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def calendar_table(days: DataFrame) -> DataFrame:
    """Distinct days with their position. The window runs over trading days,
    of which a year has at most 366, whatever the size of the panel."""
    order = Window.partitionBy(F.lit(0)).orderBy("day")
    return days.select(F.col("day").cast("bigint").alias("day")).distinct().select(
        "day", (F.row_number().over(order) - F.lit(1)).cast("bigint").alias("pos")
    )


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Calendar from a text file with one yyyymmdd day per line."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where(F.col("v") != "")
    return calendar_table(lines.select(F.col("v").cast("bigint").alias("day")))


def weekdays(days: DataFrame) -> DataFrame:
    """Drop Saturdays and Sundays from a column of yyyymmdd days."""
    parsed = F.to_date(F.col("day").cast("string"), "yyyyMMdd")
    return days.where(~F.dayofweek(parsed).isin(1, 7))


def _days(calendar: DataFrame) -> Column:
    """The sorted calendar as one array value: bounded by the number of days."""
    return calendar.agg(F.sort_array(F.collect_list("day")).alias("days")).select("days").scalar()


def _lookup(dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every date with the calendar and its two insertion points."""
    df = dates.withColumn("_days", _days(calendar))
    before = F.size(F.filter("_days", lambda d: d < F.col("date")))
    through = F.size(F.filter("_days", lambda d: d <= F.col("date")))
    return df.withColumns({"_left": before, "_right": through, "_n": F.size("_days")})


def _at(index: Column) -> Column:
    """Day at a 0-based position, null outside the calendar."""
    return F.get(F.col("_days"), index)


def _slice(start: Column, end: Column) -> Column:
    return F.slice(F.col("_days"), start + F.lit(1), F.greatest(end - start, F.lit(0)))


def is_trading_day(dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """The dates that are trading days."""
    return dates.join(calendar.select(F.col("day").alias("date")), "date", "left_semi")


def same_or_next(dates: DataFrame, calendar: DataFrame) -> DataFrame:
    return _lookup(dates, calendar).select("date", _at(F.col("_left")).alias("trading_day"))


def neighbours(dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """Strictly next and strictly previous trading day, null at the edges."""
    return _lookup(dates, calendar).select(
        "date",
        _at(F.col("_right")).alias("next_day"),
        _at(F.col("_left") - F.lit(1)).alias("prev_day"),
    )


def shift(dates: DataFrame, calendar: DataFrame, n: int) -> DataFrame:
    """n positions from the same-or-next day. Null when that day is the first of
    the calendar or the target lies outside it."""
    left = F.col("_left")
    return _lookup(dates, calendar).select(
        "date", F.when(left > 0, _at(left + F.lit(n))).alias("shifted")
    )


def around(dates: DataFrame, calendar: DataFrame, n: int) -> DataFrame:
    """Up to n days before and after, fewer near the edges."""
    if n < 1:
        raise ValueError("n must be at least 1")
    left, right, size = F.col("_left"), F.col("_right"), F.col("_n")
    return _lookup(dates, calendar).select(
        "date",
        F.when(left > 0, _slice(F.greatest(left - F.lit(n), F.lit(0)), left)).alias("days_before"),
        F.when(right < size, _slice(right, F.least(right + F.lit(n), size))).alias("days_after"),
    )


def day_range(calendar: DataFrame, start: int, end: int) -> DataFrame | None:
    """Trading days from start to end, both included; None if start > end."""
    if start > end:
        return None
    return calendar.where(F.col("day").between(start, end))


def automatic_split(calendar: DataFrame, eval_days: int = 20) -> DataFrame:
    """Train and evaluation ranges when configured dates miss the data: the last
    ``eval_days`` days evaluate, or only the last one if there are no more."""
    df = calendar.agg(F.sort_array(F.collect_list("day")).alias("_days"))
    n = F.size("_days")
    held = F.when(n > eval_days, F.lit(eval_days)).otherwise(F.lit(1))
    return df.select(
        _at(F.lit(0)).alias("train_start"),
        _at(n - held - F.lit(1)).alias("train_end"),
        _at(n - held).alias("eval_start"),
        _at(n - F.lit(1)).alias("eval_end"),
    )
