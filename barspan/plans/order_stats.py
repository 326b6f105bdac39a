"""Exact ranks and quantiles of groups of any size.

A rank over a window puts its whole group into one task. Here a group is
described instead by counts per bucket, where the bucket of a number is read off
its exponent and leading mantissa bits:

    high  sign, exponent and 12 mantissa bits    (a few million values at most)
    low   the next 20 mantissa bits              (a million values at most)

The pair is monotone in the value and depends on nothing else, so the same row
always lands in the same bucket, on any executor and in any retry. Counting is a
partial aggregation, ties collapse to one row before the shuffle, and the windows
that turn counts into positions run over one level at a time, whose size is
bounded by the bits of that level and not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barspan.plans.tables import written

_MANTISSA_HIGH = 4096.0
_MANTISSA_LOW = float(2**20)
_STRIDE = 8200
_MIN_EXPONENT = -1000


def _bucket_columns(value: Column) -> dict[str, Column]:
    size = F.abs(value)
    exponent = F.greatest(F.floor(F.log2(F.when(size > 0, size))), F.lit(_MIN_EXPONENT))
    mantissa = size * F.pow(F.lit(2.0), -exponent.cast("double")) * F.lit(_MANTISSA_HIGH)
    step = F.floor(mantissa)
    high = (exponent - F.lit(_MIN_EXPONENT)) * F.lit(_STRIDE) + step + F.lit(1)
    low = F.floor((mantissa - step) * F.lit(_MANTISSA_LOW))
    sign = F.signum(value).cast("bigint")
    return {
        "_high": F.coalesce(sign * high, F.lit(0)).cast("bigint"),
        "_low": F.coalesce(sign * low, F.lit(0)).cast("bigint"),
    }


def value_bucket(value: Column) -> Column:
    """The leading bits of a number; ascending with it."""
    return _bucket_columns(value)["_high"]


def _earlier(partition: list[str], order: str):
    spec = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    return spec.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _same(a: str, b: str, columns: list[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return condition


def value_positions(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Distinct non-null values per group with ``n_equal`` and ``n_below``.

    The counts are written once; all levels read that table.
    """
    present = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias(value))
    exact = present.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n_equal"))
    exact = written(exact.withColumns(_bucket_columns(F.col(value))), "values")
    low = exact.groupBy(*groups, "_high", "_low").agg(F.sum("n_equal").alias("_n"))
    high = low.groupBy(*groups, "_high").agg(F.sum("_n").alias("_n"))
    running = F.coalesce(F.sum("_n").over(_earlier(groups, "_high")), F.lit(0))
    high = high.select(*groups, "_high", running.alias("_below_high"))
    running = F.coalesce(F.sum("_n").over(_earlier([*groups, "_high"], "_low")), F.lit(0))
    low = low.select(*groups, "_high", "_low", running.alias("_below_low"))
    bucket = [*groups, "_high", "_low"]
    running = F.coalesce(F.sum("n_equal").over(_earlier(bucket, value)), F.lit(0))
    exact = exact.withColumn("_below_here", running)
    below = low.join(high, [*groups, "_high"]).withColumn("_below", F.col("_below_high") + F.col("_below_low"))
    return exact.join(below.select(*bucket, "_below"), bucket).select(
        *groups, value, "n_equal", (F.col("_below") + F.col("_below_here")).alias("n_below")
    )


def group_sizes(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.count(value).alias("n_values"))


def _ranks(df: DataFrame, values: dict[str, str], groups: list[str]) -> DataFrame:
    """Rank large groups: all columns are counted in one tall pass, and the
    ranks of each come back by a join on its values."""
    df = written(df, "ranked_rows")
    pairs = F.array(
        *[F.struct(F.lit(n).alias("_name"), F.col(v).cast("double").alias("_value")) for n, v in values.items()]
    )
    tall = df.select(*groups, F.inline(pairs))
    positions = value_positions(tall, [*groups, "_name"], "_value")
    sizes = group_sizes(tall, [*groups, "_name"], "_value")
    rank = F.col("n_below") + (F.col("n_equal") + F.lit(1)) / F.lit(2)
    ranked = written(
        positions.join(sizes, [*groups, "_name"]).withColumn("_rank", rank / F.col("n_values")), "ranks"
    )
    for name, v in values.items():
        own = ranked.where(F.col("_name") == name).select(*groups, "_value", F.col("_rank").alias(name))
        matches = _same("a", "b", groups) & (F.col(f"a.{v}").cast("double") == F.col("b._value"))
        df = df.alias("a").join(own.alias("b"), matches, "left").select("a.*", F.col(f"b.{name}"))
    return df


def window_pct_rank(groups: list[str], value: str) -> Column:
    """The same number as a window, for groups known to fit one task. The average
    of the first and the last position of a tie is its average rank, and both
    come from one window: rank() and the rows up to and including the ties."""
    group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    ordered = group.orderBy(F.col(value).asc_nulls_last())
    through = F.count(F.lit(1)).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rank = (F.rank().over(ordered) + through) / F.lit(2.0)
    return F.when(F.col(value).isNotNull(), F.try_divide(rank, F.count(value).over(group).cast("double")))


def pct_ranks(
    df: DataFrame, fits_task: bool, values: dict[str, str], groups: list[str]
) -> DataFrame:
    """Rank several columns per group; ``values`` maps the new name to the column."""
    if fits_task:
        return df.withColumns({name: window_pct_rank(groups, v) for name, v in values.items()})
    return _ranks(df, values, groups)


def quantiles(
    df: DataFrame, groups: list[str], value: str, wanted: dict[str, float], fits_task: bool = False
) -> DataFrame:
    """One row per group with linearly interpolated quantiles.

    Position q (n - 1) lies between two order statistics; each is the distinct
    value whose range of positions holds it, so two filtered maxima per quantile
    finish the job. Groups known to fit a task use the exact built-in aggregate.
    """
    if fits_task:
        grouped = df.groupBy(*groups) if groups else df
        return grouped.agg(*[F.percentile(value, F.lit(q)).alias(name) for name, q in wanted.items()])
    positions = value_positions(df, groups, value)
    if groups:
        positions = positions.join(group_sizes(df, groups, value), groups)
    else:
        size = df.agg(F.count(value).alias("n")).select("n").scalar()
        positions = positions.withColumn("n_values", size)
    aggregates, results = [], []
    first, last = F.col("n_below"), F.col("n_below") + F.col("n_equal") - F.lit(1)
    for name, q in wanted.items():
        at = F.lit(q) * (F.col("n_values") - F.lit(1)).cast("double")
        low, high = F.floor(at), F.ceil(at)
        inside = lambda p: F.max(F.when((first <= p) & (p <= last), F.col(value)))
        aggregates += [
            inside(low).alias(f"_lo_{name}"),
            inside(high).alias(f"_hi_{name}"),
            F.max(at - low).alias(f"_f_{name}"),
        ]
        step = (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_f_{name}")
        results.append((F.col(f"_lo_{name}") + step).alias(name))
    grouped = positions.groupBy(*groups) if groups else positions
    return grouped.agg(*aggregates).select(*groups, *results)


def smallest_rows(df: DataFrame, value: str, keep: Column, tie_break: list[str]) -> DataFrame:
    """Exactly ``keep`` rows with the smallest value, without a global sort.

    The threshold value comes from the counts; only rows tied with it, a handful
    for a hash value, are numbered.
    """
    positions = value_positions(df, [], value).withColumn("_keep", keep)
    edge = positions.where(
        (F.col("n_below") < F.col("_keep")) & (F.col("n_below") + F.col("n_equal") >= F.col("_keep"))
    ).select(F.col(value).alias("_edge"), (F.col("_keep") - F.col("n_below")).alias("_room"))
    edge_row = edge.agg(F.struct(F.max("_edge").alias("at"), F.max("_room").alias("room")).alias("e"))
    marked = df.withColumn("_e", edge_row.select("e").scalar())
    inside = marked.where(F.col(value) < F.col("_e.at"))
    ties = marked.where(F.col(value) == F.col("_e.at"))
    number = F.row_number().over(Window.partitionBy(value).orderBy(*tie_break))
    ties = ties.withColumn("_number", number).where(F.col("_number") <= F.col("_e.room")).drop("_number")
    return inside.unionByName(ties).drop("_e")
