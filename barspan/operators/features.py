"""The ten feature stages over a bar panel.

Every stage is ``(panel, df) -> df``: it adds its columns to a frame that holds
the keys, the raw channels and the columns of the stages it depends on. Stages
therefore compose into one plan without joins, and Catalyst drops the columns
nobody asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barspan.functions.scalars import (
    ABS_EPS,
    KEYS,
    RAW_EPS,
    clean,
    div_abs,
    div_eps,
    flag,
    imbalance,
    imbalance_eps,
    snap,
    total,
    zero,
)
from barspan.plans.groups import CROSS, attach, attach_bounded, cross_zscores
from barspan.plans.order_stats import pct_ranks, quantiles
from barspan.plans.series import (
    Series,
    ema_halo,
    forward_filled,
    rolling_mean,
    rolling_name,
    rolling_std,
    rolling_zscore,
    run_in_order,
    with_emas,
    with_gap_ema,
    with_positions,
    with_rolling,
)
from barspan.plans.tables import written
from barspan.sources.bars import PRICES, RATIOS, VOLUMES, Panel

# Windows, levels and source columns of the stages.
LAG_STEPS = [1, 3, 5, 10, 20, 30]
ROLL_WINDOWS = [3, 5, 10, 20, 30]
ROLL_COLUMNS = ["mid_ret1_raw", "obi0", "trade_imb", "order_pressure", "spread"]
PATCH_WINDOWS = [6, 12, 24, 60]
PATCH_COLUMNS = ["mid_ret1_raw", "obi0", "trade_imb", "spread", "order_pressure"]
FLOW_WINDOWS = [3, 6, 12, 24]
MOMENTUM_WINDOWS = [1, 3, 6, 12, 24]
BOOK_LEVELS = {
    "0": ("bid0", "ask0", "bsize0", "asize0"),
    "4": ("bid4", "ask4", "bsize0_4", "asize0_4"),
    "9": ("bid9", "ask9", "bsize5_9", "asize5_9"),
    "19": ("bid19", "ask19", "bsize10_19", "asize10_19"),
}
IMPACT_COLUMNS = [
    "trade_pressure_qty",
    "trade_pressure_turnover",
    "trade_intensity",
    "avg_trade_size",
    "avg_trade_turnover",
]
CROSS_SOURCES = [
    "midpx", "spread", "obi0", "obi4", "trade_imb", "order_pressure", "trade_activity",
    "ofi_total", "ofi_0", "ofi_4", "ofi_9", "ofi_19", *IMPACT_COLUMNS,
]
SEQUENCE_COLUMNS = [
    "midpx", "bid0", "ask0", "bid4", "ask4", "bid9", "ask9", "bsize0", "asize0", "bsize0_4",
    "asize0_4", "bsize5_9", "asize5_9", "tradeBuyQty", "tradeSellQty", "tradeBuyTurnover",
    "tradeSellTurnover", "nAddBuy", "nAddSell", "nCxlBuy", "nCxlSell", "buyVwad", "sellVwad",
]
FLAT_PRICE = 1e-12
NOON_BREAK, AFTERNOON_OPEN = 113000000, 130000000
REGIME_WEIGHTS = {"volatility": 0.35, "spread": 0.25, "pressure": 0.20, "activity": 0.10, "cancel": 0.10}
REGIME_QUANTILES = (0.33, 0.66)
STATE_ROWS = 10


def _c(name: str) -> Column:
    return F.col(name)


def with_mid(panel: Panel, df: DataFrame) -> DataFrame:
    """Mid price carried over nulls: the base of every percentage change."""
    return forward_filled(df, panel.layout, panel.limits, "midpx", "_mid")


def change(series: Series, n: int) -> Column:
    return clean(F.try_divide(_c("_mid"), series.lag("_mid", n)) - F.lit(1.0))


# -- base ----------------------------------------------------------------------


def book_shape() -> dict[str, Column]:
    return {
        "spread": clean(_c("ask0") - _c("bid0")),
        "buy_vwad_gap": clean(_c("buyVwad") - _c("midpx")),
        "sell_vwad_gap": clean(_c("sellVwad") - _c("midpx")),
    }


def book_imbalance() -> dict[str, Column]:
    by_depth = {
        "0": imbalance(_c("asize0"), _c("bsize0")),
        "4": imbalance(_c("asize0_4"), _c("bsize0_4")),
        "9": imbalance(_c("asize5_9"), _c("bsize5_9")),
    }
    return {f"obi{d}": clean(c) for d, c in by_depth.items()} | {
        f"ob_imb{d}": clean(c) for d, c in by_depth.items()
    }


def flow_imbalance() -> dict[str, Column]:
    pairs = {
        "trade_imb": ("tradeBuyQty", "tradeSellQty"),
        "trade_turnover_imb": ("tradeBuyTurnover", "tradeSellTurnover"),
        "add_imb": ("nAddBuy", "nAddSell"),
        "cxl_imb": ("nCxlBuy", "nCxlSell"),
        "qty_add_imb": ("addBuyQty", "addSellQty"),
        "qty_cxl_imb": ("cxlBuyQty", "cxlSellQty"),
    }
    return {name: clean(imbalance(_c(buy), _c(sell))) for name, (buy, sell) in pairs.items()}


def activity() -> dict[str, Column]:
    """Needs the columns of ``book_imbalance`` and ``flow_imbalance``."""
    traded = ["nTradeBuy", "nTradeSell", "tradeBuyQty", "tradeSellQty"]
    return {
        "trade_activity": clean(total(zero(_c(c)) for c in traded)),
        "order_pressure": clean(_c("obi0") + F.lit(0.5) * _c("obi4") + F.lit(0.5) * _c("trade_imb")),
    }


def base_static(df: DataFrame) -> DataFrame:
    df = df.withColumns(book_shape() | book_imbalance() | flow_imbalance())
    return df.withColumns(activity())


def base(panel: Panel, df: DataFrame) -> DataFrame:
    """The whole stage: ``base_core`` and the average of the trade imbalance,
    whose gaps are those of the uncleaned ratio."""
    flow = imbalance(_c("tradeBuyQty"), _c("tradeSellQty"))
    df = gap_average(panel, base_core(panel, df).withColumn("_flow", flow), "_flow", "trade_imbema5", 5)
    return df.withColumn("trade_imbema5", clean(_c("trade_imbema5"))).drop("_flow")


def gap_average(panel: Panel, df: DataFrame, source: str, name: str, half_life: int) -> DataFrame:
    """Exponential average over gaps. In a split panel the rows that have a value
    are numbered and chunked on their own, so a halo holds enough values however
    rare they are; the rows between them carry the last average."""
    build = lambda d, s: with_gap_ema(d, s, name, source, half_life)
    if not panel.split_series:
        return build(panel.dealt_series(df), Series(longest=panel.layout.series_rows))
    df = written(df, "rows")
    bucket = F.floor((_c("pos") - F.lit(1)) / F.lit(panel.limits.chunk_rows))
    present = with_positions(df.where(_c(source).isNotNull()).select(*KEYS, "pos", source), bucket, ["bar"], "_place")
    limits = panel.limits
    averaged = run_in_order(
        present, panel.layout.series_rows, limits.series_rows, limits.chunk_rows, build, ema_halo(half_life),
        position="_place",
    )
    joined = df.join(averaged.select(*KEYS, F.col(name).alias("_average")), KEYS, "left")
    return forward_filled(joined, panel.layout, limits, "_average", name).drop("_average")


def mid_returns(panel: Panel, df: DataFrame) -> DataFrame:
    """Returns of the mid price over one bar and twelve; needs ``midpx`` alone."""

    def build(d: DataFrame, series: Series) -> DataFrame:
        return d.withColumns({"mid_ret1_raw": change(series, 1), "bret12": change(series, 12)})

    return panel.on_series(build, 12, with_mid(panel, df)).drop("_mid")


def base_core(panel: Panel, df: DataFrame) -> DataFrame:
    df = mid_returns(panel, base_static(df))
    df = attach_bounded(panel.dealt_cross(df), panel.cross_fits, CROSS, {"_mean": F.avg("bret12")})
    return df.withColumn("lagret12", clean(snap(_c("bret12") - _c("_mean")))).drop("_mean")


# -- lag, roll, patch -----------------------------------------------------------


def lag(panel: Panel, df: DataFrame) -> DataFrame:
    def build(d: DataFrame, series: Series) -> DataFrame:
        out = {}
        for n in LAG_STEPS:
            out[f"mid_ret_lag_{n}"] = change(series, n)
            for c in ("obi0", "trade_imb", "spread"):
                out[f"{c}_lag_{n}"] = zero(series.lag(c, n))
        return d.withColumns(out)

    return panel.on_series(build, max(LAG_STEPS), with_mid(panel, df)).drop("_mid")


def roll(panel: Panel, df: DataFrame) -> DataFrame:
    def build(d: DataFrame, series: Series) -> DataFrame:
        d = with_rolling(d, series, ROLL_COLUMNS, ROLL_WINDOWS)
        out = {}
        for w in ROLL_WINDOWS:
            for c in ROLL_COLUMNS:
                out[f"{c}_rm{w}"] = F.expr(rolling_mean(c, w))
                out[f"{c}_rs{w}"] = F.expr(rolling_std(c, w))
        return d.withColumns(out).drop("_row", *rolling_helpers(ROLL_COLUMNS, ROLL_WINDOWS))

    return panel.on_series(build, max(ROLL_WINDOWS), df)


def patch(panel: Panel, df: DataFrame) -> DataFrame:
    """Summary of the last rows. The slope is the mean of the first differences
    inside the window; they telescope to the difference of its two ends."""

    def build(d: DataFrame, series: Series) -> DataFrame:
        d = with_rolling(d, series, PATCH_COLUMNS, PATCH_WINDOWS)
        ends = {f"_first_{c}": F.first(c).over(series.so_far) for c in PATCH_COLUMNS}
        ends |= {f"_lag{w}_{c}": series.lag(c, w) for c in PATCH_COLUMNS for w in PATCH_WINDOWS}
        d = d.withColumns(ends)
        out = {}
        for c in PATCH_COLUMNS:
            for w in PATCH_WINDOWS:
                name = lambda kind: f"{c}_patch{w}_{kind}"  # noqa: B023
                high, low = f"`{rolling_name(c, w, 'max')}`", f"`{rolling_name(c, w, 'min')}`"
                out |= {
                    name("mean"): F.expr(rolling_mean(c, w)),
                    name("std"): F.expr(rolling_std(c, w)),
                    name("max"): F.expr(high),
                    name("min"): F.expr(low),
                    name("range"): F.expr(f"{high} - {low}"),
                    name("slope"): F.expr(
                        f"case when _row = 0 then 0D else (`{c}` - coalesce(`_lag{w}_{c}`, `_first_{c}`)) "
                        f"/ least(_row, {w}) end"
                    ),
                    name("last"): _c(c),
                }
        return d.withColumns(out).drop("_row", *ends, *rolling_helpers(PATCH_COLUMNS, PATCH_WINDOWS))

    return panel.on_series(build, max(PATCH_WINDOWS) + 1, df)


def rolling_helpers(columns: list[str], windows: list[int]) -> list[str]:
    return [rolling_name(c, w, k) for c in columns for w in windows for k in ("sum", "squares", "max", "min")]


# -- order flow -----------------------------------------------------------------


def turnover() -> Column:
    return zero(_c("tradeBuyTurnover")) + zero(_c("tradeSellTurnover"))


def level_flow(series: Series) -> dict[str, Column]:
    """Order-flow imbalance of each book level against the previous bar."""
    out = {}
    for level, (bid, ask, bid_size, ask_size) in BOOK_LEVELS.items():
        was_bid, was_ask = series.lag(bid), series.lag(ask)
        was_bid_size, was_ask_size = series.lag(bid_size), series.lag(ask_size)
        out[f"bid_ofi_{level}"] = clean(
            F.when(_c(bid) > was_bid, _c(bid_size))
            .when(_c(bid) == was_bid, _c(bid_size) - was_bid_size)
            .otherwise(-was_bid_size)
        )
        out[f"ask_ofi_{level}"] = clean(
            F.when(_c(ask) < was_ask, -_c(ask_size))
            .when(_c(ask) == was_ask, was_ask_size - _c(ask_size))
            .otherwise(was_ask_size)
        )
    return out


def flow_ratios(df: DataFrame) -> DataFrame:
    levels = list(BOOK_LEVELS)
    df = df.withColumn("_turnover", turnover())
    df = df.withColumns(
        {f"ofi_{v}": _c(f"bid_ofi_{v}") + _c(f"ask_ofi_{v}") for v in levels}
        | {f"ofi_{v}_depth": clean(_c(b) + _c(a)) for v, (_, _, b, a) in BOOK_LEVELS.items()}
    )
    df = df.withColumns(
        {f"ofi_{v}_div_depth": clean(div_abs(_c(f"ofi_{v}"), _c(f"ofi_{v}_depth"))) for v in levels}
        | {f"ofi_{v}_div_turnover": clean(div_abs(_c(f"ofi_{v}"), _c("_turnover"))) for v in levels}
        | {
            "ofi_total": total(_c(f"ofi_{v}") for v in levels),
            "ofi_total_depth": total(_c(f"ofi_{v}_depth") for v in levels),
        }
    )
    return df.withColumns(
        {
            "ofi_abs": F.abs("ofi_total"),
            "ofi_sign": F.signum("ofi_total"),
            "ofi_div_total_depth": clean(div_abs(_c("ofi_total"), _c("ofi_total_depth"))),
            "ofi_div_turnover": clean(div_abs(_c("ofi_total"), _c("_turnover"))),
        }
    ).drop("_turnover")


def dynamics(d: DataFrame, series: Series, columns: list[str]) -> DataFrame:
    """EMA, sum, mean and z-score of each column over the flow windows."""
    d = with_emas(d, series, {f"{c}_ema{w}": (c, w) for c in columns for w in FLOW_WINDOWS})
    d = with_rolling(d, series, columns, FLOW_WINDOWS)
    out = {}
    for c in columns:
        for w in FLOW_WINDOWS:
            out[f"{c}_sum{w}"] = _c(rolling_name(c, w, "sum"))
            out[f"{c}_mean{w}"] = F.expr(rolling_mean(c, w))
            out[f"{c}_z{w}"] = F.expr(rolling_zscore(c, w, ABS_EPS))
    return d.withColumns(out).drop("_row", *rolling_helpers(columns, FLOW_WINDOWS))


def ofi_levels(panel: Panel, df: DataFrame) -> DataFrame:
    """Levels, ratios and totals of the order-flow stage, without its dynamics."""
    return flow_ratios(panel.on_series(lambda d, s: d.withColumns(level_flow(s)), 1, df))


def ofi(panel: Panel, df: DataFrame) -> DataFrame:
    def build(d: DataFrame, series: Series) -> DataFrame:
        return dynamics(flow_ratios(d.withColumns(level_flow(series))), series, ["ofi_total"])

    return panel.on_series(build, ema_halo(max(FLOW_WINDOWS)) + 1, df)


# -- trade impact ---------------------------------------------------------------


def impact_static(df: DataFrame) -> DataFrame:
    buy_qty, sell_qty = zero(_c("tradeBuyQty")), zero(_c("tradeSellQty"))
    buy_turnover, sell_turnover = zero(_c("tradeBuyTurnover")), zero(_c("tradeSellTurnover"))
    trades = zero(_c("nTradeBuy")) + zero(_c("nTradeSell"))
    return df.withColumns(
        {
            "signed_trade_qty": clean(buy_qty - sell_qty),
            "signed_trade_turnover": clean(buy_turnover - sell_turnover),
            "trade_pressure_qty": clean(div_abs(buy_qty - sell_qty, buy_qty + sell_qty)),
            "trade_pressure_turnover": clean(div_abs(buy_turnover - sell_turnover, turnover())),
            "trade_intensity": clean(trades),
            "avg_trade_size": clean(div_abs(buy_qty + sell_qty, trades)),
            "avg_trade_turnover": clean(div_abs(turnover(), trades)),
        }
    )


def impact_interactions(df: DataFrame) -> DataFrame:
    pressure = _c("trade_pressure_qty")
    return df.withColumns(
        {
            "trade_pressure_x_spread": clean(pressure * _c("spread")),
            "trade_pressure_x_order_pressure": clean(pressure * _c("order_pressure")),
            "trade_pressure_x_ofi": clean(pressure * _c("ofi_total")),
        }
    )


def impact_levels(panel: Panel, df: DataFrame) -> DataFrame:
    return impact_interactions(impact_static(df))


def trade_impact(panel: Panel, df: DataFrame) -> DataFrame:
    df = impact_levels(panel, df)
    return panel.on_series(lambda d, s: dynamics(d, s, IMPACT_COLUMNS), ema_halo(max(FLOW_WINDOWS)), df)


# -- cross-section --------------------------------------------------------------


def _stored(columns: list[str]) -> dict[str, Column]:
    """Stage columns as the store keeps them: at float precision. Differences in
    the last bits of a double would otherwise rank, or scale, equal values."""
    return {f"_f_{c}": _c(c).cast("float").cast("double") for c in columns}


def cross_z(panel: Panel, df: DataFrame) -> DataFrame:
    stored = _stored(CROSS_SOURCES)
    df = cross_zscores(panel.dealt_cross(df.withColumns(stored)), panel.cross_fits, {f"{c}_cs_z": f"_f_{c}" for c in CROSS_SOURCES})
    return df.withColumns({f"{c}_cs_z": clean(_c(f"{c}_cs_z")) for c in CROSS_SOURCES}).drop(*stored)


def cross_rank(panel: Panel, df: DataFrame, dealt: bool = False) -> DataFrame:
    """Average percentage rank of the stored values; ``dealt`` says that rows lie by cross-section already."""
    stored = _stored(CROSS_SOURCES)
    ranks = {f"{c}_cs_rank": f"_f_{c}" for c in CROSS_SOURCES}
    df = df.withColumns(stored)
    df = pct_ranks(df if dealt else panel.dealt_cross(df), panel.cross_fits, ranks, CROSS)
    return df.withColumns({f"{c}_cs_rank": zero(_c(f"{c}_cs_rank")) for c in CROSS_SOURCES}).drop(*stored)


def time_of_day(panel: Panel, df: DataFrame) -> DataFrame:
    df = pct_ranks(df, panel.date_fits, {"interval_pos": "bar"}, ["date"])
    return df.withColumns(
        {
            "interval_pos": zero(_c("interval_pos")),
            "interval_norm": _c("bar").cast("double") / F.lit(1e8),
            "is_morning": flag(_c("bar") < NOON_BREAK),
            "is_afternoon": flag(_c("bar") >= AFTERNOON_OPEN),
        }
    )


def cross(panel: Panel, df: DataFrame) -> DataFrame:
    return time_of_day(panel, cross_rank(panel, cross_z(panel, df), dealt=True))


# -- momentum -------------------------------------------------------------------


def momentum_returns(panel: Panel, df: DataFrame) -> DataFrame:
    """Returns over each window, raw and against the cross-section."""

    def build(d: DataFrame, series: Series) -> DataFrame:
        d = d.withColumns({f"lagret{w}_raw": change(series, w) for w in MOMENTUM_WINDOWS})
        return d.withColumns(
            {f"_vol{w}": zero(series.std("mid_ret1_raw", min(STATE_ROWS, w + 2))) for w in MOMENTUM_WINDOWS}
        )

    df = panel.on_series(build, max(MOMENTUM_WINDOWS), with_mid(panel, df)).drop("_mid")
    means = {f"_mean{w}": F.avg(f"lagret{w}_raw") for w in MOMENTUM_WINDOWS}
    df = attach_bounded(panel.dealt_cross(df), panel.cross_fits, CROSS, means)
    df = df.withColumns(
        {f"lagret{w}": snap(_c(f"lagret{w}_raw") - _c(f"_mean{w}")) for w in MOMENTUM_WINDOWS}
    )
    return df.withColumns(
        {f"lagret{w}_abs": F.abs(f"lagret{w}") for w in MOMENTUM_WINDOWS}
        | {f"lagret{w}_sign": F.signum(f"lagret{w}") for w in MOMENTUM_WINDOWS}
    ).drop(*means)


def momentum_interactions(df: DataFrame) -> DataFrame:
    out = {}
    for w in MOMENTUM_WINDOWS:
        others = {"trade_pressure": "trade_pressure_qty", "ofi": "ofi_total", "spread": "spread", "vol": f"_vol{w}"}
        out |= {f"lagret{w}_x_{n}": clean(_c(f"lagret{w}") * _c(c)) for n, c in others.items()}
    return df.withColumns(out)


def momentum_states(panel: Panel, df: DataFrame) -> DataFrame:
    df = df.withColumn("_f", _c("lagret12").cast("float").cast("double"))
    df = pct_ranks(df, panel.date_fits, {"conditional_momentum_rank": "_f"}, ["date"])
    return df.withColumns(
        {
            "momentum_state": flag(_c("lagret12") > 0),
            "reversal_state": flag(_c("lagret12") < 0),
            "conditional_momentum_rank": zero(_c("conditional_momentum_rank")),
        }
    ).drop("_f")


def conditional_momentum(panel: Panel, df: DataFrame) -> DataFrame:
    df = momentum_interactions(momentum_returns(panel, df))
    return momentum_states(panel, df).drop(*[f"_vol{w}" for w in MOMENTUM_WINDOWS])


# -- regime ---------------------------------------------------------------------


def volatility(panel: Panel, df: DataFrame) -> DataFrame:
    return panel.on_series(
        lambda d, s: d.withColumn("_vol10", snap(zero(s.std("mid_ret1_raw", STATE_ROWS)))), STATE_ROWS, df
    )


def date_means(panel: Panel, df: DataFrame) -> DataFrame:
    return attach(
        df,
        ["date"],
        {
            "_vol_mean": F.avg("_vol10"),
            "state_spread_cs": F.avg("spread"),
            "state_activity_cs": F.avg("trade_activity"),
        },
        cut=not panel.date_fits,
    )


def regime_score() -> Column:
    w = REGIME_WEIGHTS
    relative = _c("_vol10") / F.coalesce(F.when(_c("_vol_mean") != 0, _c("_vol_mean")), F.lit(1.0))
    return clean(
        snap(
            F.lit(w["volatility"]) * relative
            + F.lit(w["spread"]) * _c("spread")
            + F.lit(w["pressure"]) * F.abs("order_pressure")
            + F.lit(w["activity"]) * _c("trade_activity")
            + F.lit(w["cancel"]) * F.abs("cxl_imb"),
            9,
        )
    )


def date_thresholds(panel: Panel, df: DataFrame) -> DataFrame:
    """One row per date: two score quantiles and three medians."""
    measures = {
        "score": _c("regime_score"),
        "vol": _c("_vol10"),
        "spread": snap(_c("spread"), 9),
        "pressure": snap(_c("order_pressure"), 9),
    }
    low, high = REGIME_QUANTILES
    if panel.date_fits:
        at = lambda m, q: F.percentile(measures[m], F.lit(q))
        return df.groupBy("date").agg(
            at("score", low).alias("_score_low"),
            at("score", high).alias("_score_high"),
            *[at(m, 0.5).alias(f"_{m}_median") for m in ("vol", "spread", "pressure")],
        )
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), c.alias("value")) for m, c in measures.items()])
    tall = df.select("date", F.explode(pairs).alias("p")).select("date", "p.measure", "p.value")
    cut = quantiles(tall, ["date", "measure"], "value", {"low": low, "high": high, "median": 0.5})
    pick = lambda m, q: F.max(F.when(_c("measure") == m, _c(q)))
    return cut.groupBy("date").agg(
        pick("score", "low").alias("_score_low"),
        pick("score", "high").alias("_score_high"),
        *[pick(m, "median").alias(f"_{m}_median") for m in ("vol", "spread", "pressure")],
    )


def regime_states() -> dict[str, Column]:
    score = _c("regime_score")
    return {
        "regime_low": flag(score <= _c("_score_low")),
        "regime_mid": flag((score > _c("_score_low")) & (score <= _c("_score_high"))),
        "regime_high": flag(score > _c("_score_high")),
        "state_momentum": flag((_c("mid_ret1_raw") > 0) & (_c("_vol10") < _c("_vol_median"))),
        "state_reversal": flag((_c("mid_ret1_raw") < 0) & (snap(_c("spread"), 9) > _c("_spread_median"))),
        "state_pressure": flag(snap(F.abs("order_pressure"), 9) > F.abs("_pressure_median")),
        "state_liquidity": flag(_c("trade_activity") < _c("state_activity_cs")),
    }


def date_volatility(panel: Panel, df: DataFrame) -> DataFrame:
    """Std of the last 10 returns of the date in (symbol, bar) order: it runs
    across symbols, so long dates are cut at positions within the date."""
    if not panel.date_fits:
        df = written(df, "rows")
        sizes = df.groupBy("date", "symbol").agg(F.count(F.lit(1)).alias("_n"))
        before = Series(("date",), order="symbol").ordered.rowsBetween(-(2**31), -1)
        sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        own = _c("pos") if panel.split_series else F.row_number().over(Series().ordered)
        df = df.withColumn("_own", own).join(sizes, ["date", "symbol"])
        df = df.withColumn("_at", _c("_before") + _c("_own")).drop("_before", "_own")
    else:
        df = df.withColumn("_at", F.struct("symbol", "bar"))
    out = run_in_order(
        df,
        panel.layout.date_rows,
        panel.limits.date_rows,
        panel.limits.chunk_rows,
        lambda d, s: d.withColumn("state_vol_cs", clean(s.std("mid_ret1_raw", STATE_ROWS))),
        STATE_ROWS,
        ("date",),
        "_at",
        "_at",
    )
    return out.drop("_at")


def regime(panel: Panel, df: DataFrame) -> DataFrame:
    df = date_means(panel, volatility(panel, df)).withColumn("regime_score", regime_score())
    df = df.join(date_thresholds(panel, df), "date").withColumns(regime_states())
    spare = ["_vol10", "_vol_mean", "_score_low", "_score_high", "_vol_median", "_spread_median", "_pressure_median"]
    return date_volatility(panel, df).drop(*spare)


# -- micro-structure extras -------------------------------------------------------


def _positive_price(name: str) -> Column:
    return F.when(F.abs(_c(name)) >= F.lit(RAW_EPS), _c(name))


def _relative(numerator: Column) -> Column:
    return clean(div_eps(numerator, _positive_price("midpx")))


def _log1p_ratio(a: Column, b: Column) -> Column:
    ratio = div_eps(a, b)
    return clean(F.when(ratio > F.lit(-1.0), F.log1p(ratio)))


def micro_orders() -> dict[str, Column]:
    adds, cancels = _c("nAddBuy") + _c("nAddSell"), _c("nCxlBuy") + _c("nCxlSell")
    trades = _c("nTradeBuy") + _c("nTradeSell")
    add_imb = imbalance_eps(_c("nAddBuy"), _c("nAddSell"))
    cxl_imb = imbalance_eps(_c("nCxlBuy"), _c("nCxlSell"))
    return {
        "rx_cxl_rate_cnt": clean(div_eps(cancels, adds)),
        "rx_cxl_rate_qty": clean(div_eps(_c("cxlBuyQty") + _c("cxlSellQty"), _c("addBuyQty") + _c("addSellQty"))),
        "rx_add_imb_to": clean(imbalance_eps(_c("addBuyTurnover"), _c("addSellTurnover"))),
        "rx_cxl_imb_to": clean(imbalance_eps(_c("cxlBuyTurnover"), _c("cxlSellTurnover"))),
        "rx_net_order_press": clean(add_imb - cxl_imb),
        "rx_add_vs_trade": _log1p_ratio(adds, trades),
        "rx_cxl_vs_trade": _log1p_ratio(cancels, trades),
    }


def _raw_imbalances() -> list[Column]:
    return [imbalance_eps(_c(a), _c(b)) for _, _, b, a in BOOK_LEVELS.values()]


def micro_book() -> dict[str, Column]:
    best, near, mid, deep = _raw_imbalances()
    inner, outer = _c("ask0") - _c("bid0"), _c("ask4") - _c("bid4")
    return {
        "rx_obi19": clean(deep),
        "rx_obi_weighted": clean(
            F.lit(0.4) * best + F.lit(0.3) * near + F.lit(0.2) * mid + F.lit(0.1) * deep
        ),
        "rx_depth_nf_bid": _log1p_ratio(_c("bsize0_4"), _c("bsize10_19")),
        "rx_depth_nf_ask": _log1p_ratio(_c("asize0_4"), _c("asize10_19")),
        "rx_spread_deep_rel": _relative(outer - inner),
    }


def micro_trades() -> dict[str, Column]:
    return {
        "rx_vwad_gap_buy": _relative(_c("buyVwad") - _c("midpx")),
        "rx_vwad_gap_sell": _relative(_c("sellVwad") - _c("midpx")),
        "rx_trade_range_buy": _relative(_c("tradeBuyHigh") - _c("tradeBuyLow")),
        "rx_trade_range_sell": _relative(_c("tradeSellHigh") - _c("tradeSellLow")),
    }


def micro_shape() -> dict[str, Column]:
    """Needs ``rx_net_order_press``."""
    best, _, _, deep = _raw_imbalances()
    bids = total(_c(b) for _, _, b, _ in BOOK_LEVELS.values())
    asks = total(_c(a) for _, _, _, a in BOOK_LEVELS.values())
    micro = div_eps(_c("bid0") * _c("asize0") + _c("ask0") * _c("bsize0"), _c("asize0") + _c("bsize0"))
    trade = imbalance_eps(_c("tradeBuyQty"), _c("tradeSellQty"))
    return {
        "rx2_microprice_dev": _relative(micro - _c("midpx")),
        "rx2_depth_imb_all": clean(div_eps(bids - asks, bids + asks)),
        "rx2_conc_bid": clean(div_eps(_c("bsize0"), bids)),
        "rx2_conc_ask": clean(div_eps(_c("asize0"), asks)),
        "rx2_obi_term": clean(deep - best),
        "rx2_spread_rel": _relative(_c("ask0") - _c("bid0")),
        "rx2_press_x_tradeimb": clean(_c("rx_net_order_press") * trade),
    }


def micro_prices() -> dict[str, Column]:
    return {
        "rx3_lastpx_dev": _relative(_c("lastpx") - _c("midpx")),
        "rx3_hl_range": _relative(_c("high") - _c("low")),
        "rx3_oc_ret": clean(div_eps(_c("midpx") - _c("open"), _positive_price("open"))),
    }


def micro_turnover() -> dict[str, Column]:
    bids, asks = ["btr0_4", "btr5_9", "btr10_19"], ["atr0_4", "atr5_9", "atr10_19"]
    bid_sum, ask_sum = total(map(_c, bids)), total(map(_c, asks))
    return {
        "rx3_to_imb_04": clean(imbalance_eps(_c(bids[0]), _c(asks[0]))),
        "rx3_to_imb_59": clean(imbalance_eps(_c(bids[1]), _c(asks[1]))),
        "rx3_to_imb_1019": clean(imbalance_eps(_c(bids[2]), _c(asks[2]))),
        "rx3_to_imb_all": clean(div_eps(bid_sum - ask_sum, total(map(_c, bids + asks)))),
        "rx3_to_nf_b": _log1p_ratio(_c(bids[0]), _c(bids[2])),
        "rx3_to_nf_a": _log1p_ratio(_c(asks[0]), _c(asks[2])),
    }


def micro_order_prices() -> dict[str, Column]:
    return {
        "rx3_addbuy_range": _relative(_c("addBuyHigh") - _c("addBuyLow")),
        "rx3_addsell_range": _relative(_c("addSellHigh") - _c("addSellLow")),
        "rx3_addbuy_lvl": _relative(_c("addBuyHigh") - _c("midpx")),
        "rx3_addsell_lvl": _relative(_c("addSellLow") - _c("midpx")),
        "rx3_cxlbuy_lvl": _relative(_c("cxlBuyHigh") - _c("midpx")),
        "rx3_cxlsell_lvl": _relative(_c("cxlSellLow") - _c("midpx")),
    }


def micro_static(df: DataFrame) -> DataFrame:
    df = df.withColumns(
        micro_orders() | micro_book() | micro_trades() | micro_prices() | micro_turnover() | micro_order_prices()
    )
    return df.withColumns(micro_shape())


MICRO_EMAS = {
    "rx_net_press_ema5": ("rx_net_order_press", 5),
    "rx_cxl_rate_ema5": ("rx_cxl_rate_cnt", 5),
    "rx_obi_w_ema5": ("rx_obi_weighted", 5),
    "rx2_net_press_ema12": ("rx_net_order_press", 12),
}
MICRO_ZSCORES = {
    "rx2_net_press_z12": "rx_net_order_press",
    "rx2_obi_w_z12": "rx_obi_weighted",
    "rx2_cxl_rate_z12": "rx_cxl_rate_cnt",
    "rx2_micro_dev_z12": "rx2_microprice_dev",
}
MICRO_WINDOW = 12


def micro_dynamics(d: DataFrame, series: Series) -> DataFrame:
    d = with_emas(d, series, MICRO_EMAS)
    log_mid = F.when(_c("midpx").isNotNull(), F.log(F.greatest(_c("midpx"), F.lit(RAW_EPS))))
    add_imb = imbalance_eps(_c("nAddBuy"), _c("nAddSell"))
    d = d.withColumns({"_log_mid": log_mid, "_add_imb": add_imb})
    d = d.withColumn("_log_ret", zero(_c("_log_mid") - series.lag("_log_mid")))
    out = {}
    out["rx_add_imb_chg"] = clean(_c("_add_imb") - series.lag("_add_imb"))
    out |= {n: clean(series.zscore(c, MICRO_WINDOW, RAW_EPS, min_rows=2)) for n, c in MICRO_ZSCORES.items()}
    enough = F.count("_log_ret").over(series.last(MICRO_WINDOW)) >= 2
    out["rx2_rvol12"] = clean(F.when(enough, series.std("_log_ret", MICRO_WINDOW)))
    d = d.withColumns(out)
    d = d.withColumn("rx2_cxl_x_rvol", clean(_c("rx_cxl_rate_cnt") * _c("rx2_rvol12")))
    return d.drop("_log_mid", "_log_ret", "_add_imb")


def rx_micro(panel: Panel, df: DataFrame) -> DataFrame:
    return panel.on_series(micro_dynamics, ema_halo(MICRO_WINDOW), micro_static(df))


# -- raw channels -----------------------------------------------------------------


def channel_names() -> list[str]:
    return ["midpx_logret", *[f"{c}_rel" for c in PRICES], *[f"{c}_log" for c in VOLUMES], *RATIOS]


def raw_channels(panel: Panel, df: DataFrame) -> DataFrame:
    """59 lightly normalised channels; a missing raw column is an error."""
    missing = [c for c in ["midpx", *PRICES, *VOLUMES, *RATIOS] if c not in df.columns]
    if missing:
        raise ValueError(f"missing channels: {missing}")
    mid = F.when(F.abs(_c("midpx")) >= F.lit(FLAT_PRICE), _c("midpx"))

    def build(d: DataFrame, series: Series) -> DataFrame:
        log_mid = F.when(_c("midpx") > 0, F.log("midpx"))
        d = d.withColumn("_log", log_mid)
        return d.withColumn("midpx_logret", clean(_c("_log") - series.lag("_log"))).drop("_log")

    df = panel.on_series(build, 1, df)
    out = {
        f"{c}_rel": clean(F.when(_c(c) > 0, _c(c) / mid - F.lit(1.0)).otherwise(F.lit(0.0))) for c in PRICES
    }
    out |= {f"{c}_log": clean(F.log1p(F.when(_c(c) > 0, _c(c)).otherwise(F.lit(0.0)))) for c in VOLUMES}
    return df.withColumns(out | {c: clean(_c(c)) for c in RATIOS})


def sequence_lags(panel: Panel, df: DataFrame, lags: list[int]) -> DataFrame:
    """Raw sequence columns and their lags, 0 before the start of a series."""

    def build(d: DataFrame, series: Series) -> DataFrame:
        return d.withColumns(
            {f"{c}_seq_lag_{n}": clean(series.lag(c, n)) for c in SEQUENCE_COLUMNS for n in lags}
        )

    df = panel.on_series(build, max(lags), df)
    return df.withColumns({c: clean(_c(c)) for c in SEQUENCE_COLUMNS})


