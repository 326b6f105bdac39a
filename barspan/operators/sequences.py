"""Sequence windows of a series and snapshots of a cross-section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barspan.functions.scalars import KEYS, LABEL, zero
from barspan.plans.digests import compared
from barspan.plans.groups import CROSS, attach_bounded
from barspan.plans.order_stats import value_positions
from barspan.plans.series import Series
from barspan.plans.tables import written
from barspan.sources.bars import Panel
from barspan.sources.store import FeatureStore

# Scale floors of the normalizer and of the snapshot z-score.
MIN_SCALE = 1e-8
SNAPSHOT_VARIANCE_FLOOR = 1e-5


def _position(panel: Panel, series: Series) -> Column:
    return F.col("pos") if panel.split_series else F.row_number().over(series.ordered)


def window_ends(panel: Panel, length: int, df: DataFrame | None = None) -> DataFrame:
    """Rows that end a full window: the first length - 1 rows of a series warm up."""
    return panel.on_series(
        lambda d, s: d.withColumn("_at", _position(panel, s)), length, df
    ).where(F.col("_at") >= length).drop("_at")


def window_labels(panel: Panel, length: int) -> DataFrame:
    return window_ends(panel, length).select(*KEYS, zero(F.col(LABEL)).alias("label"))


def gather_windows(panel: Panel, df: DataFrame, channels: list[str], length: int) -> DataFrame:
    """keys, x = array of ``length`` channel vectors oldest first, label of the last row."""

    def build(d: DataFrame, series: Series) -> DataFrame:
        vector = F.array(*[zero(F.col(c)) for c in channels])
        return d.withColumns(
            {"_at": _position(panel, series), "x": F.collect_list(vector).over(series.last(length))}
        )

    out = panel.on_series(build, length, df).where(F.col("_at") >= length)
    return out.select(*KEYS, "x", zero(F.col(LABEL)).alias("label"))


def flat_vectors(df: DataFrame, channels: list[str]) -> DataFrame:
    """Keys, one channel vector per row, label and its presence."""
    missing = [c for c in [*KEYS, *channels] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    has_label = LABEL in df.columns
    label = zero(F.col(LABEL)) if has_label else F.lit(0.0)
    vector = F.array(*[zero(F.col(c)).cast("double") for c in channels])
    return df.select(*KEYS, vector.alias("x"), label.alias("label"), F.lit(has_label).alias("has_label"))


def stored_vectors(store: FeatureStore, groups: list[str], labels: DataFrame) -> DataFrame:
    """Flat vectors of the columns of stored groups with the labels of another table.

    Both must hold the same keys equally often; a digest per date tells without joining rows, and names the dates where they
    don't. The labels replace the store's own.
    """
    features = store.load(groups=groups, dtype="float64").drop(LABEL)
    uneven = compared(features, labels, ["date"], KEYS).where(~F.col("same")).orderBy("date").limit(5).collect()
    if uneven:
        raise ValueError(f"features and labels differ in their keys: {[(r['date'], r['n_left'], r['n_right']) for r in uneven]}")
    return flat_vectors(features.join(labels.select(*KEYS, LABEL), KEYS), store.catalogue.columns(groups))


def only_dates(df: DataFrame, dates: DataFrame) -> DataFrame:
    return df.join(dates.select("date"), "date", "left_semi")


# -- normalizer -------------------------------------------------------------------


class Normalizer:
    """Per-channel standardization with statistics of the training rows only."""

    def __init__(self, channels: list[str], mode: str = "zscore"):
        if mode not in ("zscore", "identity"):
            raise ValueError(f"unknown normalizer mode {mode!r}")
        self.channels, self.mode = channels, mode
        self._statistics: DataFrame | None = None

    def fit(self, train: DataFrame) -> Normalizer:
        """One aggregation; the result is one row however many rows train."""
        aggregates = []
        for c in self.channels:
            x = zero(F.col(c))
            scale = F.stddev_pop(x)
            aggregates += [
                F.avg(x).alias(f"mean_{c}"),
                F.when(scale < MIN_SCALE, F.lit(1.0)).otherwise(scale).alias(f"scale_{c}"),
            ]
        self._statistics = train.agg(F.struct(*aggregates).alias("s"))
        return self

    def statistics(self) -> DataFrame:
        """channel, mean, scale."""
        if self._statistics is None:
            raise RuntimeError("the normalizer is not fitted")
        rows = F.array(
            *[
                F.struct(
                    F.lit(c).alias("channel"), F.col(f"s.mean_{c}").alias("mean"), F.col(f"s.scale_{c}").alias("scale")
                )
                for c in self.channels
            ]
        )
        return self._statistics.select(F.inline(rows))

    def transform(self, df: DataFrame) -> DataFrame:
        if self.mode == "identity":
            return df.withColumns({c: zero(F.col(c)) for c in self.channels})
        if self._statistics is None:
            raise RuntimeError("the normalizer is not fitted")
        df = df.withColumn("_s", self._statistics.select("s").scalar())
        scaled = {
            c: F.when(F.col(f"_s.mean_{c}").isNull(), zero(F.col(c))).otherwise(
                (zero(F.col(c)) - F.col(f"_s.mean_{c}")) / F.col(f"_s.scale_{c}")
            )
            for c in self.channels
        }
        return df.withColumns(scaled).drop("_s")


# -- snapshots --------------------------------------------------------------------


def symbol_places(rows: DataFrame) -> DataFrame:
    """symbol and _place, its rank among all symbols in the order of its own type.

    Ranges of symbols are numbered side by side and shifted by the ranges before them,
    so no task sorts all symbols; ranks are small whole numbers whatever the symbols are.
    """
    names = rows.select("symbol").distinct().repartitionByRange("symbol")
    names = written(names.withColumn("_range", F.spark_partition_id()), "symbols")
    per_range = names.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("symbol"))
    numbered = names.withColumn("_i", inside).join(per_range, "_range")
    return numbered.select("symbol", (F.col("_before") + F.col("_i")).cast("double").alias("_place"))


def member_slots(panel: Panel, rows: DataFrame) -> DataFrame:
    """Add slot, the 0-based place of a symbol in its (date, bar), and size.

    A cross-section holds one row per symbol. Where that is more than a task
    takes, the place is the number of smaller symbols, counted by value.
    """
    if panel.cross_fits:
        slot = F.row_number().over(Window.partitionBy(*CROSS).orderBy("symbol")) - F.lit(1)
        size = F.count(F.lit(1)).over(Window.partitionBy(*CROSS))
        return rows.withColumns({"slot": slot.cast("bigint"), "size": size})
    placed = rows.join(symbol_places(rows), "symbol")
    below = value_positions(placed, CROSS, "_place").select(*CROSS, "_place", F.col("n_below").alias("slot"))
    sizes = rows.groupBy(*CROSS).agg(F.count(F.lit(1)).alias("size"))
    return placed.join(below, [*CROSS, "_place"]).drop("_place").join(sizes, CROSS)


def snapshots(panel: Panel, ends: DataFrame, columns: list[str]) -> DataFrame:
    """Window ends regrouped by (date, bar), members in ascending symbol order.

    One row holds at most ``page_members`` members, so a snapshot of any size is
    a run of pages and ordinary snapshots are page 0 alone.
    """
    placed = member_slots(panel, ends)
    page = F.floor(F.col("slot") / F.lit(panel.limits.page_members))
    member = F.struct("slot", "symbol", *columns)
    return (
        placed.groupBy(*CROSS, page.alias("page"))
        .agg(F.max("size").alias("size"), F.sort_array(F.collect_list(member)).alias("members"))
    )


def snapshot_sizes(ends: DataFrame) -> DataFrame:
    return ends.groupBy(*CROSS).agg(F.count(F.lit(1)).alias("n_members"))


def flat_order(panel: Panel, ends: DataFrame) -> DataFrame:
    """Every member with the index of its snapshot and its slot."""
    return member_slots(panel, ends).join(snapshot_index(ends), CROSS)


def snapshot_index(ends: DataFrame) -> DataFrame:
    """Number the snapshots in (date, bar) order.

    Bars are numbered inside their date and shifted by the snapshots of earlier
    dates, a running sum with one row per trading day.
    """
    keys = ends.select(*CROSS).distinct()
    per_date = keys.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    per_date = per_date.select("date", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("date").orderBy("bar")) - F.lit(1)
    return keys.withColumn("_i", inside).join(per_date, "date").select(
        *CROSS, (F.col("_before") + F.col("_i")).cast("bigint").alias("snapshot")
    )


def padded_batches(panel: Panel, ends: DataFrame, columns: list[str], batch: int) -> DataFrame:
    """Snapshots in batches, padded to the largest of their batch.

    batch, date, bar, page, symbols / one array per column padded with 0, mask. Every
    snapshot has all pages of its batch's width; pages past its members are padding.
    """
    index = snapshot_index(ends).withColumn("batch", F.floor(F.col("snapshot") / F.lit(batch)))
    per_page = panel.limits.page_members
    found = snapshots(panel, ends, columns)
    sizes = snapshot_sizes(ends).join(index, CROSS)
    widest = sizes.groupBy("batch").agg(F.max("n_members").alias("_width"))
    last = F.floor((F.col("_width") - F.lit(1)) / F.lit(per_page))
    wanted = index.join(widest, "batch").withColumn("page", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    pages = wanted.join(found.select(*CROSS, "page", "members"), [*CROSS, "page"], "left")
    nobody = F.array().cast(found.schema["members"].dataType)
    pages = pages.withColumn("members", F.coalesce("members", nobody))
    room = F.least(F.col("_width") - F.col("page") * F.lit(per_page), F.lit(per_page)).cast("int")
    missing = F.greatest(room - F.size("members"), F.lit(0))
    pad = lambda name, filler: F.concat(F.col(f"members.{name}"), F.array_repeat(filler, missing))
    symbol_type = dict(ends.dtypes)["symbol"]
    return pages.select(
        "batch",
        "snapshot",
        *CROSS,
        "page",
        pad("symbol", F.lit(None).cast(symbol_type)).alias("symbols"),
        *[pad(c, F.lit(0.0)).alias(c) for c in columns],
        F.concat(
            F.array_repeat(F.lit(True), F.size("members")), F.array_repeat(F.lit(False), missing)
        ).alias("mask"),
    )


def snapshot_zscores(panel: Panel, df: DataFrame, columns: list[str]) -> DataFrame:
    """z across the members of a snapshot, population variance floored."""
    statistics = {}
    for c in columns:
        statistics |= {f"_m_{c}": F.avg(zero(F.col(c))), f"_v_{c}": F.var_pop(zero(F.col(c)))}
    df = attach_bounded(df, panel.cross_fits, CROSS, statistics)
    scaled = {
        f"{c}_sz": (zero(F.col(c)) - F.col(f"_m_{c}"))
        / F.sqrt(F.greatest(F.col(f"_v_{c}"), F.lit(SNAPSHOT_VARIANCE_FLOOR)))
        for c in columns
    }
    return df.withColumns(scaled).drop(*statistics)
