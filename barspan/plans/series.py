"""Time-ordered computations inside one (date, symbol) series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barspan.functions.scalars import zero
from barspan.plans.layout import Layout, Limits
from barspan.plans.tables import written

# Past this exponent the closed form of the exponential average would leave the
# range of a double (2**1023), so longer series restart it in blocks.
SAFE_EXPONENT = 900
# A block of 128 half-lives leaves a remainder of 2**-128 of anything older.
BLOCK_HALF_LIVES = 128


@dataclass(frozen=True)
class Series:
    """Window specs of a series, or of one chunk of a split series."""

    partition: tuple[str, ...] = ("date", "symbol")
    longest: int = 0
    order: str = "bar"

    @cached_property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(self.order)

    def last(self, rows: int) -> WindowSpec:
        return self.ordered.rowsBetween(-(rows - 1), 0)

    @cached_property
    def so_far(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, c: Column | str, n: int = 1) -> Column:
        return F.lag(c, n).over(self.ordered)

    @property
    def row(self) -> Column:
        """0-based position in the whole series."""
        if "chunk" in self.partition:
            return F.col("pos") - F.lit(1)
        return F.row_number().over(self.ordered) - F.lit(1)

    # -- rolling statistics -------------------------------------------------

    def mean(self, c: Column | str, rows: int) -> Column:
        return F.avg(c).over(self.last(rows))

    def std(self, c: Column | str, rows: int) -> Column:
        return F.stddev_pop(c).over(self.last(rows))

    def zscore(self, c: Column | str, rows: int, eps: float, min_rows: int = 1) -> Column:
        """(x - mean) / (std + eps); exactly 0 on a constant window."""
        w = self.last(rows)
        x = F.col(c) if isinstance(c, str) else c
        z = F.when(F.max(x).over(w) == F.min(x).over(w), F.lit(0.0)).otherwise(
            (x - F.avg(x).over(w)) / (F.stddev_pop(x).over(w) + F.lit(eps))
        )
        return z if min_rows <= 1 else F.when(F.count(x).over(w) >= min_rows, z)


def run_in_order(
    df: DataFrame,
    longest: int,
    allowed: int,
    chunk_rows: int,
    build: Callable[[DataFrame, Series], DataFrame],
    halo: int,
    keys: tuple[str, ...] = ("date", "symbol"),
    order: str = "bar",
    position: str = "pos",
) -> DataFrame:
    """Run ``build`` over every ordered group, splitting groups that are too long.

    ``df`` carries ``position``, the 1-based row number in the group, whenever a
    group is longer than ``allowed``. Such a table is cut into chunks of
    ``chunk_rows`` rows; the last ``halo`` rows of a chunk are copied in front of
    the next one and dropped afterwards, so each window sees all the rows it
    needs and no task holds more than one chunk.
    """
    if longest <= allowed:
        return build(df, Series(keys, longest, order))
    rows = max(chunk_rows, halo)
    offset = F.col(position) - F.lit(1)
    home = F.floor(offset / F.lit(rows))
    in_tail = offset % F.lit(rows) >= F.lit(rows - halo)
    copies = F.when(in_tail, F.array(home, home + F.lit(1))).otherwise(F.array(home))
    split = df.withColumn("chunk", F.explode(copies)).withColumn("is_halo", F.col("chunk") != home)
    built = build(split, Series((*keys, "chunk"), longest, order))
    return built.where(~F.col("is_halo")).drop("chunk", "is_halo")


def run_on_series(
    df: DataFrame,
    layout: Layout,
    limits: Limits,
    build: Callable[[DataFrame, Series], DataFrame],
    halo: int,
) -> DataFrame:
    return run_in_order(df, layout.series_rows, limits.series_rows, limits.chunk_rows, build, halo)


def with_positions(df: DataFrame, bucket: Column, order: list[str], name: str = "pos") -> DataFrame:
    """Add ``name``, the row number in a series, without sorting a series in one task.

    Rows are counted per (series, bucket); the running count over the buckets of
    a series is a small window, because a day has a bounded number of buckets.
    Rows are then numbered inside their bucket only.
    """
    rows = df.withColumn("_bucket", bucket.cast("bigint"))
    counts = rows.groupBy("date", "symbol", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("date", "symbol").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy("date", "symbol", "_bucket").orderBy(*order)
    return (
        rows.join(counts, ["date", "symbol", "_bucket"])
        .withColumn(name, (F.col("_before") + F.row_number().over(inside)).cast("bigint"))
        .drop("_bucket", "_before")
    )


def forward_filled(df: DataFrame, layout: Layout, limits: Limits, source: str, name: str) -> DataFrame:
    """Last non-null value so far. A gap may be longer than any halo, so in a
    split panel the value at the end of each chunk is carried to the next ones."""
    if layout.series_rows <= limits.series_rows:
        return df.withColumn(name, F.last(source, ignorenulls=True).over(Series().so_far))
    keys = ["date", "symbol", "_chunk"]
    df = written(df, "rows")
    chunked = df.withColumn("_chunk", F.floor((F.col("pos") - F.lit(1)) / F.lit(limits.chunk_rows)))
    present = chunked.where(F.col(source).isNotNull())
    ends = chunked.select(*keys).distinct().join(
        present.groupBy(*keys).agg(F.max_by(source, "pos").alias("_end")), keys, "left"
    )
    before = Window.partitionBy("date", "symbol").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    here = F.last(source, ignorenulls=True).over(Series(tuple(keys)).so_far)
    return chunked.join(ends, keys).withColumn(name, F.coalesce(here, "_carried")).drop("_chunk", "_carried")


# -- nested rolling windows ---------------------------------------------------


def _pieces(window: int, known: list[int]) -> list[int] | None:
    """Known windows that lie end to end in a larger one, longest first."""
    parts, left = [], window
    for w in sorted(known, reverse=True):
        while w <= left:
            parts.append(w)
            left -= w
    return parts if left == 0 else None


def rolling_name(column: str, window: int, kind: str) -> str:
    return f"_{kind}{window}_{column}"


def with_rolling(df: DataFrame, series: Series, columns: list[str], windows: list[int]) -> DataFrame:
    """Add sum, squares, max and min of non-null columns over several windows.

    ``squares`` is the sum of squared deviations from the window mean. Spark
    evaluates a sliding frame anew for every row, so a window of 60 rows costs 60
    steps. A window that is a chain of shorter ones needs none: its statistics
    are those of its parts, found by lag, and merge exactly. Only the shortest
    windows are evaluated row by row. Adds ``_row``, the position in the series.
    """
    df = df.withColumn("_row", series.row)
    levels: list[list[tuple[int, list[int] | None]]] = [[]]
    known: list[int] = []
    depth: dict[int, int] = {}
    for w in sorted(windows):
        parts = _pieces(w, known)
        at = 0 if parts is None else 1 + max(depth[p] for p in parts)
        while len(levels) <= at:
            levels.append([])
        levels[at].append((w, parts))
        depth[w] = at
        known.append(w)
    for level in levels:
        added, merged = {}, {}
        for w, parts in level:
            if parts is None:
                frame = series.last(w)
                for c in columns:
                    n = F.expr(f"cast(least(_row + 1, {w}) as double)")
                    added[rolling_name(c, w, "sum")] = F.sum(c).over(frame)
                    added[rolling_name(c, w, "squares")] = F.var_pop(c).over(frame) * n
                    added[rolling_name(c, w, "max")] = F.max(c).over(frame)
                    added[rolling_name(c, w, "min")] = F.min(c).over(frame)
                continue
            offset = 0
            for i, part in enumerate(parts):
                if offset:
                    for c in columns:
                        for kind in ("sum", "squares", "max", "min"):
                            source = rolling_name(c, part, kind)
                            added[f"_p{i}_{rolling_name(c, w, kind)}"] = F.lag(source, offset).over(series.ordered)
                offset += part
            for c in columns:
                merged |= _merged(c, w, parts)
        df = df.withColumns(added) if added else df
        df = df.withColumns(merged).drop(*[n for n in added if n.startswith("_p")]) if merged else df
    return df


def _merged(c: str, w: int, parts: list[int]) -> dict[str, Column]:
    pieces, offset = [], 0
    for i, part in enumerate(parts):
        name = lambda kind: f"_p{i}_{rolling_name(c, w, kind)}" if offset else rolling_name(c, part, kind)  # noqa: B023
        n = f"cast(least(_row + 1 - {offset}, {part}) as double)"
        pieces.append((n, {kind: f"`{name(kind)}`" for kind in ("sum", "squares", "max", "min")}))
        offset += part
    whole = " + ".join(f"coalesce({p['sum']}, 0D)" for _, p in pieces)
    mean = f"(({whole}) / least(_row + 1, {w}))"
    squares = " + ".join(
        f"coalesce({p['squares']} + {n} * pow({p['sum']} / {n} - {mean}, 2), 0D)"
        if i == 0
        else f"case when {n} > 0 then {p['squares']} + {n} * pow({p['sum']} / {n} - {mean}, 2) else 0D end"
        for i, (n, p) in enumerate(pieces)
    )
    listed = lambda kind: ", ".join(p[kind] for _, p in pieces)
    return {
        rolling_name(c, w, "sum"): F.expr(whole),
        rolling_name(c, w, "squares"): F.expr(squares),
        rolling_name(c, w, "max"): F.expr(f"greatest({listed('max')})"),
        rolling_name(c, w, "min"): F.expr(f"least({listed('min')})"),
    }


def rolling_mean(c: str, w: int) -> str:
    return f"(`{rolling_name(c, w, 'sum')}` / least(_row + 1, {w}))"


def rolling_std(c: str, w: int) -> str:
    return f"sqrt(`{rolling_name(c, w, 'squares')}` / least(_row + 1, {w}))"


def rolling_zscore(c: str, w: int, eps: float) -> str:
    high, low = rolling_name(c, w, "max"), rolling_name(c, w, "min")
    return (
        f"case when `{high}` = `{low}` then 0D "
        f"else (`{c}` - {rolling_mean(c, w)}) / ({rolling_std(c, w)} + {eps!r}D) end"
    )


# -- exponential averages ----------------------------------------------------


def ema_halo(half_life: int) -> int:
    return 2 * BLOCK_HALF_LIVES * half_life


def with_emas(df: DataFrame, series: Series, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """Add y0 = x0, y = (1-a) y + a x with a = 1 - 2**(-1/half_life).

    ``wanted`` maps the new column to (source column, half life). A null source
    counts as 0, the value every stage stores for it. With k the position in the
    series the recursion is sum(x w 2**(k/h)) 2**(-k/h), one running sum; the two
    powers are shared by all columns of a half life. Series too long for that
    restart in blocks and carry the end of the block before.
    """
    split = "chunk" in series.partition
    df = df.withColumn("_k", series.row)
    spans = sorted({h for _, h in wanted.values()})
    helpers, blocks, blocked = {}, {}, []
    for h in spans:
        j = "_k"
        if split or series.longest > SAFE_EXPONENT * h:
            size = BLOCK_HALF_LIVES * h
            j = f"_k % {size}"
            blocks[f"_b{h}"] = F.expr(f"cast(floor(_k / {size}) as bigint)")
            helpers[f"_last{h}"] = F.expr(f"{j} = {size - 1}")
            helpers[f"_fade{h}"] = F.expr(f"pow(2D, -({j} + 1) / {h}D)")
            blocked.append(h)
        a = 1.0 - 2.0 ** (-1.0 / h)
        helpers[f"_grow{h}"] = F.expr(f"pow(2D, ({j}) / {h}D) * case when _k = 0 then 1D else {a!r}D end")
        helpers[f"_shrink{h}"] = F.expr(f"pow(2D, -({j}) / {h}D)")
    df = df.withColumns(helpers | blocks)
    local = {}
    for name, (source, h) in wanted.items():
        spec = series if h not in blocked else Series((*series.partition, f"_b{h}"), series.longest, series.order)
        run = F.sum(zero(F.col(source)) * F.col(f"_grow{h}")).over(spec.so_far)
        local[name] = run * F.col(f"_shrink{h}")
    df = df.withColumns(local)
    if blocked:
        before = series.ordered.rowsBetween(Window.unboundedPreceding, -1)
        carried = {}
        for name, (_, h) in wanted.items():
            if h in blocked:
                ended = F.last(F.when(F.col(f"_last{h}"), F.col(name)), ignorenulls=True).over(before)
                carried[name] = F.col(name) + zero(ended) * F.col(f"_fade{h}")
        df = df.withColumns(carried)
    return df.drop("_k", *helpers, *blocks)


def with_gap_ema(df: DataFrame, series: Series, name: str, source: str, half_life: int) -> DataFrame:
    """Exponential average of a column whose nulls are skipped, not zeroed.

    The weight of the past decays at every row, the value moves only where the
    source is present: y = (w y + a x) / (w + a) with w = q**gap. Written with
    b = a / (q**gap + a) this is again one running sum, of b x / prod(1 - b).
    """
    a = 1.0 - 2.0 ** (-1.0 / half_life)
    q = 1.0 - a
    x = F.col(source)
    split = "chunk" in series.partition
    here = F.col("pos") if split else F.row_number().over(series.ordered)
    df = df.withColumn("_k", here)
    before = series.ordered.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_gap", F.col("_k") - F.last(F.when(x.isNotNull(), F.col("_k")), True).over(before))
    old = F.pow(F.lit(q), F.col("_gap").cast("double"))
    b = F.when(x.isNull(), F.lit(0.0)).when(F.col("_gap").isNull(), F.lit(1.0)).otherwise(F.lit(a) / (old + F.lit(a)))
    keep = F.when(x.isNull() | F.col("_gap").isNull(), F.lit(0.0)).otherwise(F.log(old / (old + F.lit(a))))
    df = df.withColumns({"_b": b, "_keep": keep, "_n": F.count(x).over(series.so_far)})
    size = BLOCK_HALF_LIVES * half_life
    df = df.withColumn("_blk", F.floor(F.greatest(F.col("_n") - F.lit(1), F.lit(0)) / F.lit(size)))
    block = Series((*series.partition, "_blk"), series.longest, series.order)
    df = df.withColumn("_s", F.sum("_keep").over(block.so_far))
    local = F.sum(F.col("_b") * zero(x) * F.exp(-F.col("_s"))).over(block.so_far) * F.exp(F.col("_s"))
    df = df.withColumn("_local", local)
    ended = F.when(x.isNotNull() & (F.col("_n") % F.lit(size) == F.lit(0)), F.col("_local"))
    df = df.withColumn("_end", F.last(ended, True).over(before))
    y = F.when(x.isNotNull(), F.col("_local") + zero(F.col("_end")) * F.exp(F.col("_s")))
    return df.withColumn(name, F.last(y, True).over(series.so_far)).drop(
        "_k", "_gap", "_b", "_keep", "_n", "_blk", "_s", "_local", "_end"
    )
