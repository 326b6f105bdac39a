"""Column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

KEYS = ["date", "symbol", "bar"]
LABEL = "fret12"

# The two division guards, the variance guard of R2 and the
# smallest usable price.
ABS_EPS = 1e-8
RAW_EPS = 1e-9
R2_EPS = 1e-8
FLAT_STD = 1e-12

INF = float("inf")


def total(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def div_abs(a: Column, b: Column) -> Column:
    """a / (|b| + 1e-8): 0/0 is 0 and x/0 is huge, never null."""
    return a / (F.abs(b) + F.lit(ABS_EPS))


def div_eps(a: Column, b: Column) -> Column:
    """a / (b + 1e-9), signed; a divisor of exactly zero gives null."""
    return F.try_divide(a, b + F.lit(RAW_EPS))


def imbalance(a: Column, b: Column) -> Column:
    return div_abs(a - b, a + b)


def imbalance_eps(a: Column, b: Column) -> Column:
    return div_eps(a - b, a + b)


def finite(c: Column) -> Column:
    """NaN and infinities become null (NaN sorts above infinity in Spark)."""
    return F.when(F.abs(c) < F.lit(INF), c)


def clean(c: Column) -> Column:
    """The final rule for every feature: null, NaN and infinity become 0."""
    return F.coalesce(finite(c), F.lit(0.0))


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def snap(c: Column, digits: int = 12) -> Column:
    """Move a difference of averages onto a fixed decimal grid.

    Values that are equal on paper then compare equal whatever the order in
    which a cluster added them up, so signs, ranks and thresholds are stable.
    """
    scale = F.lit(float(10**digits))
    return F.when(F.abs(c) < F.lit(9e18 / 10**digits), F.floor(c * scale + F.lit(0.5)) / scale).otherwise(c)


def clip(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(c, high), low)


def pearson(x: Column, y: Column) -> Column:
    """Pearson as an aggregate; null when a side does not vary.

    ``corr`` raises under ANSI mode on a constant side, hence the long form.
    """
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.try_divide(
        F.covar_pop(x, y),
        F.when((sx > F.lit(FLAT_STD)) & (sy > F.lit(FLAT_STD)), sx * sy),
    )


def shown_scale(name: str) -> float:
    """Factor under which a column is compared: squared errors of returns are about 1e-7,
    linear predictions about 1e-5 and returns times volatility about 1e-8, so that six
    decimals of the plain value would hold nothing of them."""
    if "mse" in name and "pct" not in name:
        return 1e9
    if name.startswith("lagret") and name.endswith("_x_vol"):
        return 1e6
    return 1e3 if name == "pred" else 1.0


def presented(name: str) -> Column:
    """Six decimals of the scaled value at float precision: the form in which results are compared."""
    x = f"(`{name}` * {shown_scale(name)!r}D)" if shown_scale(name) != 1.0 else f"`{name}`"
    return F.expr(
        f"cast(cast(case when abs({x}) < 1e12D then floor({x} * 1e6D + 0.5D) / 1e6D else {x} end as float) as double) "
        f"as `{name}`"
    )
