"""The bar panel: one row per (date, symbol, bar), 59 channels and a label."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barspan.functions.scalars import KEYS, LABEL, clean
from barspan.plans.layout import Layout, Limits, dealt, measure
from barspan.plans.series import Series, run_on_series, with_positions
from barspan.plans.tables import written

# The channels of a bar, by kind.
PRICES = [
    "lastpx", "open", "high", "low",
    "bid0", "ask0", "bid4", "ask4", "bid9", "ask9", "bid19", "ask19",
    "tradeBuyHigh", "tradeBuyLow", "buyVwad", "tradeSellHigh", "tradeSellLow", "sellVwad",
    "addBuyHigh", "addBuyLow", "addSellHigh", "addSellLow",
    "cxlBuyHigh", "cxlBuyLow", "cxlSellHigh", "cxlSellLow",
]
VOLUMES = [
    "bsize0", "asize0", "bsize0_4", "asize0_4", "bsize5_9", "asize5_9", "bsize10_19", "asize10_19",
    "nTradeBuy", "tradeBuyQty", "tradeBuyTurnover", "nTradeSell", "tradeSellQty", "tradeSellTurnover",
    "nAddBuy", "addBuyQty", "addBuyTurnover", "nAddSell", "addSellQty", "addSellTurnover",
    "nCxlBuy", "cxlBuyQty", "cxlBuyTurnover", "nCxlSell", "cxlSellQty", "cxlSellTurnover",
]
RATIOS = ["btr0_4", "atr0_4", "btr5_9", "atr5_9", "btr10_19", "atr10_19"]
CHANNELS = ["midpx", *PRICES, *VOLUMES, *RATIOS]

LABEL_HORIZON = 12


@dataclass(frozen=True)
class Panel:
    """Bars with their measured layout; every operator starts from one."""

    df: DataFrame
    layout: Layout
    limits: Limits = field(default_factory=Limits)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def split_series(self) -> bool:
        return self.layout.series_rows > self.limits.series_rows

    @property
    def cross_fits(self) -> bool:
        return self.layout.cross_rows <= self.limits.cross_rows

    @property
    def date_fits(self) -> bool:
        return self.layout.date_rows <= self.limits.date_rows

    @property
    def total_fits(self) -> bool:
        """All rows together fit one task."""
        return self.layout.total_rows <= self.limits.date_rows

    def with_df(self, df: DataFrame) -> Panel:
        return replace(self, df=df)

    def on_series(
        self, build: Callable[[DataFrame, Series], DataFrame], halo: int, df: DataFrame | None = None
    ) -> DataFrame:
        return run_on_series(self.df if df is None else df, self.layout, self.limits, build, halo)

    def dealt_series(self, df: DataFrame) -> DataFrame:
        """Whole series in tasks of a bounded number of rows; split series are dealt in chunks anyway."""
        return df if self.split_series else dealt(df, self.layout, self.limits, ["date", "symbol"])

    def dealt_cross(self, df: DataFrame) -> DataFrame:
        """Whole cross-sections in tasks of a bounded number of rows; too large ones are aggregated instead."""
        return dealt(df, self.layout, self.limits, ["date", "bar"]) if self.cross_fits else df

    def carried(self) -> list[str]:
        """Keys to keep next to computed columns (``pos`` only in split panels)."""
        return [*KEYS, "pos"] if self.split_series else list(KEYS)


def read_panel(
    spark: SparkSession, path: str, dates: list[int] | None = None, limits: Limits | None = None, check_keys: bool = True
) -> Panel:
    """Panel from a parquet table of bars, partitioned by date.

    A (date, symbol, bar) occurs once: group sizes rest on that, so a repeated key is
    an error. ``dates`` becomes a partition filter. NaN is read as null, which Spark's
    aggregates skip the way pandas skips NaN.
    """
    limits = limits or Limits()
    df = spark.read.parquet(path)
    if dates is not None:
        if not dates:
            raise ValueError("no dates given")
        df = df.where(F.col("date").isin([int(d) for d in dates]))
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    df = df.select(
        *[F.col(k).cast("bigint").alias(k) if k != "symbol" else F.col(k) for k in KEYS],
        *[_null_for_nan(c) if c in numeric else F.col(c) for c in df.columns if c not in KEYS],
    )
    if check_keys and not df.groupBy(*KEYS).count().where("count > 1").isEmpty():
        raise ValueError("a bar key (date, symbol, bar) occurs more than once")
    layout = measure(df.select("date", "symbol"))
    if layout.series_rows > limits.series_rows:
        # A bar key is HHMMSSmmm, so a second holds at most 1000 bars of a series.
        df = written(with_positions(df, F.floor(F.col("bar") / F.lit(1000)), ["bar"]), "bars")
    return Panel(df, layout, limits)


def _null_for_nan(name: str) -> Column:
    return F.when(~F.isnan(F.col(name)), F.col(name).cast("double")).alias(name)


# -- bars derived from an event log -------------------------------------------

def panel_from_events(spark: SparkSession, sf_dir: str, limits: Limits | None = None) -> Panel:
    """Panel whose bars are the rows of ``events``: symbol = user_id mod 10, one
    bar per event in time order inside each (date, symbol)."""
    limits = limits or Limits()
    ts = F.col("ts")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.year(ts) * F.lit(10000) + F.month(ts) * F.lit(100) + F.dayofmonth(ts)).cast("bigint").alias("date"),
        (F.col("user_id") % F.lit(10)).alias("symbol"),
        ts,
        "event_id",
        F.col("event_type").alias("et"),
        F.round(F.col("value") * F.lit(100)).cast("bigint").alias("v"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
    )
    layout = measure(events.select("date", "symbol"))
    order = ["ts", "event_id"]
    if layout.series_rows > limits.series_rows:
        second = F.hour(ts) * F.lit(3600) + F.minute(ts) * F.lit(60) + F.second(ts)
        numbered = written(with_positions(events, second, order), "events")
    else:
        in_time = Window.partitionBy("date", "symbol").orderBy(*order)
        events = dealt(events, layout, limits, ["date", "symbol"])
        numbered = events.withColumn("pos", F.row_number().over(in_time).cast("bigint"))
    numbered = numbered.withColumns(_book(numbered))

    def label(df: DataFrame, series: Series) -> DataFrame:
        ahead = F.lead("mid2", LABEL_HORIZON).over(replace(series, order="pos").ordered)
        forward = ahead.cast("double") / F.col("mid2").cast("double") - F.lit(1.0)
        return df.withColumn(LABEL, F.coalesce(forward, F.lit(0.0)))

    if layout.series_rows > limits.series_rows:
        # The label looks ahead, so number the series backwards for the split.
        sizes = numbered.groupBy("date", "symbol").agg(F.max("pos").alias("_size"))
        back = numbered.join(sizes, ["date", "symbol"]).withColumn("_pos", F.col("pos"))
        back = back.withColumn("pos", F.col("_size") - F.col("pos") + F.lit(1)).drop("_size")

        def label_back(df: DataFrame, series: Series) -> DataFrame:
            ahead = F.lag("mid2", LABEL_HORIZON).over(replace(series, order="pos").ordered)
            forward = ahead.cast("double") / F.col("mid2").cast("double") - F.lit(1.0)
            return df.withColumn(LABEL, F.coalesce(forward, F.lit(0.0)))

        labelled = run_on_series(back, layout, limits, label_back, LABEL_HORIZON)
        labelled = written(labelled.withColumn("pos", F.col("_pos")), "events")
    else:
        labelled = run_on_series(numbered, layout, limits, label, LABEL_HORIZON)
    kept = ["date", "symbol", _bar_key().alias("bar")]
    if layout.series_rows > limits.series_rows:
        kept.append("pos")
    return Panel(labelled.select(*kept, *[c.alias(n) for n, c in _channels().items()], LABEL), layout, limits)


def _bar_key() -> Column:
    return (F.lit(93000000) + (F.col("pos") - F.lit(1)) * F.lit(1000000)).cast("bigint")


def _book(df: DataFrame) -> dict[str, Column]:
    v, k, et = F.col("v"), F.col("k"), F.col("et")
    return {
        "mid2": F.lit(10000) + F.lit(100) * F.col("symbol") + v % 5 + F.col("pos") % 3,
        "hs": F.lit(1) + k % 3,
        "nb": F.when(et == "purchase", F.lit(1) + k % 5).otherwise(F.lit(0)),
        "ns": F.when(et.isin("purchase", "click"), k % 4).otherwise(F.lit(0)),
        "ab": v % 6,
        "asl": k % 6,
        "cb": v % 4,
        "cs": k % 4,
    }


def _channels() -> dict[str, Column]:
    v, k, mid2, hs = F.col("v"), F.col("k"), F.col("mid2"), F.col("hs")
    number = lambda c: c.cast("double")
    cents = lambda c: c.cast("double") / F.lit(100)
    price_if = lambda n, c: F.when(n > 0, cents(c)).otherwise(F.lit(0.0))
    out: dict[str, Column] = {"midpx": cents(mid2)}
    nb, ns = F.col("nb"), F.col("ns")
    out["lastpx"] = price_if(nb + ns, mid2 + k % 3 - 1)
    out["open"] = cents(F.lit(10000) + F.lit(100) * F.col("symbol") + v % 3)
    out["high"], out["low"] = cents(mid2 + hs + 1), cents(mid2 - hs - 1)
    for depth in (0, 4, 9, 19):
        out[f"bid{depth}"], out[f"ask{depth}"] = cents(mid2 - hs - depth), cents(mid2 + hs + depth)
    out |= {
        "bsize0": number(100 + v % 97),
        "asize0": number(100 + k % 89),
        "bsize0_4": number(400 + (3 * v) % 301),
        "asize0_4": number(400 + (7 * k + v) % 307),
        "bsize5_9": number(500 + v % 211),
        "asize5_9": number(500 + (v + k) % 223),
        "bsize10_19": number(900 + v % 401),
        "asize10_19": number(900 + (v + 3 * k) % 409),
    }
    buy_size, sell_size = 10 + v % 13, 10 + k % 11
    out["nTradeBuy"], out["tradeBuyQty"] = number(nb), number(nb * buy_size)
    out["tradeBuyTurnover"] = cents(nb * buy_size * (mid2 + hs))
    out["tradeBuyHigh"], out["tradeBuyLow"] = price_if(nb, mid2 + hs + 1), price_if(nb, mid2 + hs)
    out["buyVwad"] = F.when(nb > 0, number(2 * mid2 + 2 * hs + 1) / F.lit(200))
    out["nTradeSell"], out["tradeSellQty"] = number(ns), number(ns * sell_size)
    out["tradeSellTurnover"] = cents(ns * sell_size * (mid2 - hs))
    out["tradeSellHigh"], out["tradeSellLow"] = price_if(ns, mid2 - hs), price_if(ns, mid2 - hs - 1)
    out["sellVwad"] = F.when(ns > 0, number(2 * mid2 - 2 * hs - 1) / F.lit(200))
    sides = {
        "addBuy": ("nAddBuy", F.col("ab"), 5 + k % 9, mid2 - hs, mid2 - hs, mid2 - hs - 2),
        "addSell": ("nAddSell", F.col("asl"), 5 + v % 7, mid2 + hs, mid2 + hs + 2, mid2 + hs),
        "cxlBuy": ("nCxlBuy", F.col("cb"), 3 + k % 5, mid2 - hs, mid2 - hs - 1, mid2 - hs - 3),
        "cxlSell": ("nCxlSell", F.col("cs"), 3 + v % 5, mid2 + hs, mid2 + hs + 3, mid2 + hs + 1),
    }
    for side, (count_name, n, size, price, high, low) in sides.items():
        out[count_name], out[f"{side}Qty"] = number(n), number(n * size)
        out[f"{side}Turnover"] = cents(n * size * price)
        out[f"{side}High"], out[f"{side}Low"] = price_if(n, high), price_if(n, low)
    out["btr0_4"], out["atr0_4"] = cents(1 + v % 50), cents(1 + k % 50)
    out["btr5_9"], out["atr5_9"] = cents(1 + v % 30), cents(1 + (v + k) % 30)
    out["btr10_19"], out["atr10_19"] = cents(1 + v % 20), cents(1 + (v + 2 * k) % 20)
    return out


# -- scans --------------------------------------------------------------------


def scan_days(panel: Panel, days: DataFrame) -> DataFrame:
    """Bars of the listed trading days; a hash semi join prunes the rest."""
    return panel.df.join(days.select(F.col("day").alias("date")), "date", "left_semi")


def check_days(requested: list[int], trading_days: list[int]) -> None:
    if not requested:
        raise ValueError("no dates given")
    unknown = sorted(set(requested) - set(trading_days))
    if unknown:
        raise ValueError(f"not trading days: {unknown}")


def count_per_day(panel: Panel) -> DataFrame:
    return panel.df.groupBy("date").agg(F.count(F.lit(1)).alias("n_rows"))


def available_days(panel: Panel, configured: DataFrame | None = None) -> DataFrame:
    """Days found in the data, together with the configured calendar days."""
    found = panel.df.select(F.col("date").alias("day")).distinct()
    return found if configured is None else found.unionByName(configured.select("day")).distinct()


def first_symbols(panel: Panel, n: int) -> DataFrame:
    """Bars of the n smallest symbols."""
    chosen = panel.df.select("symbol").distinct().orderBy("symbol").limit(n)
    return panel.df.join(chosen, "symbol", "left_semi")


def keys_and_label(panel: Panel) -> DataFrame:
    return panel.df.select(*KEYS, clean(F.col(LABEL)).alias(LABEL))
