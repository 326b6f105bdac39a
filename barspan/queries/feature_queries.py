"""Feature stages as registered queries over the ``events`` bars."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from barspan.functions.scalars import KEYS, presented
from barspan.operators import features as fx
from barspan.plans import catalogue as cat
from barspan.plans.catalogue import CATALOGUE
from barspan.sources.bars import Panel, panel_from_events

Query = Callable[[SparkSession, str], DataFrame]


def show(df: DataFrame, numbers: Iterable[str], keys: Iterable[str] = KEYS) -> DataFrame:
    return df.select(*keys, *[presented(c) for c in numbers])


def stage_query(build: Callable[[Panel], DataFrame], numbers: Iterable[str] | Callable[[], dict]) -> Query:
    """``numbers`` lists the columns to return, or is the function that builds them."""

    def over(panel: Panel) -> DataFrame:
        return show(build(panel), numbers() if callable(numbers) else numbers)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return over(panel_from_events(spark, sf_dir))

    run.over = over
    return run


def _upto(*stages: str) -> Callable[[Panel], DataFrame]:
    return lambda panel: CATALOGUE.with_stages(panel, stages)


def _impact(panel: Panel) -> DataFrame:
    """Everything the cross-section and momentum stages read, without dynamics."""
    return CATALOGUE.with_stages(panel, {n: [] for n in ("base", "ofi", "trade_impact")})


def _cross_sources(panel: Panel) -> DataFrame:
    """What the cross-section scores read and nothing beside it: a split panel writes rows between its steps."""
    df = fx.impact_static(fx.ofi_levels(panel, fx.base_static(panel.df)))
    return df.select(*panel.carried(), *fx.CROSS_SOURCES)


def _regime(panel: Panel) -> DataFrame:
    """The regime stage over the columns that it reads."""
    own = ["midpx", "spread", "order_pressure", "trade_activity", "cxl_imb"]
    return fx.regime(panel, fx.mid_returns(panel, fx.base_static(panel.df).select(*panel.carried(), *own)))


LEVELS = list(fx.BOOK_LEVELS)
_DYNAMIC = lambda names: [f"{c}_{k}{w}" for c in names for w in fx.FLOW_WINDOWS for k in ("ema", "sum", "mean", "z")]

QUERIES: dict[str, Query] = {
    "d01_spread_and_gaps": stage_query(lambda p: p.df.withColumns(fx.book_shape()), fx.book_shape),
    "d02_book_imbalance": stage_query(lambda p: p.df.withColumns(fx.book_imbalance()), fx.book_imbalance),
    "d03_flow_imbalance": stage_query(lambda p: p.df.withColumns(fx.flow_imbalance()), fx.flow_imbalance),
    "d04_mid_return": stage_query(_upto("base"), ["mid_ret1_raw"]),
    "d05_trade_imbalance_ema": stage_query(_upto("base"), ["trade_imbema5"]),
    "d06_lagged_return": stage_query(_upto("base"), ["bret12", "lagret12"]),
    "d07_activity_and_pressure": stage_query(lambda p: fx.base_static(p.df), ["trade_activity", "order_pressure"]),
    "d08_lags": stage_query(_upto("lag"), cat.LAG),
    "d09_rolling": stage_query(_upto("roll"), cat.ROLL),
    "d10_patches": stage_query(_upto("patch"), cat.PATCH),
    "d11_order_flow_levels": stage_query(
        lambda p: fx.ofi_levels(p, p.df), [f"{s}ofi_{v}" for v in LEVELS for s in ("bid_", "ask_", "")]
    ),
    "d12_order_flow_ratios": stage_query(
        lambda p: fx.ofi_levels(p, p.df),
        [f"ofi_{v}_{k}" for v in LEVELS for k in ("depth", "div_depth", "div_turnover")],
    ),
    "d13_order_flow_totals": stage_query(
        lambda p: fx.ofi_levels(p, p.df),
        ["ofi_total", "ofi_total_depth", "ofi_abs", "ofi_sign", "ofi_div_total_depth", "ofi_div_turnover"],
    ),
    "d14_order_flow_dynamics": stage_query(_upto("ofi"), _DYNAMIC(["ofi_total"])),
    "d15_trade_impact": stage_query(
        lambda p: fx.impact_static(p.df), ["signed_trade_qty", "signed_trade_turnover", *fx.IMPACT_COLUMNS]
    ),
    "d16_trade_impact_interactions": stage_query(_impact, cat.IMPACT_INTERACTION),
    "d17_trade_impact_dynamics": stage_query(_upto("trade_impact"), _DYNAMIC(fx.IMPACT_COLUMNS)),
    "d18_cross_zscores": stage_query(lambda p: fx.cross_z(p, _cross_sources(p)), cat.CROSS_Z),
    "d19_cross_ranks": stage_query(lambda p: fx.cross_rank(p, _impact(p)), cat.CROSS_RANK),
    "d20_time_of_day": stage_query(
        lambda p: fx.time_of_day(p, p.df), ["interval_pos", "interval_norm", "is_morning", "is_afternoon"]
    ),
    "d21_momentum_returns": stage_query(
        lambda p: fx.momentum_returns(p, fx.base_core(p, p.df)),
        [f"lagret{w}{k}" for w in fx.MOMENTUM_WINDOWS for k in ("_raw", "", "_abs", "_sign")],
    ),
    "d22_momentum_interactions": stage_query(
        _upto("conditional_momentum"), [c for c in cat.MOMENTUM if "_x_" in c]
    ),
    "d23_momentum_states": stage_query(
        _upto("conditional_momentum"), ["momentum_state", "reversal_state", "conditional_momentum_rank"]
    ),
    "d24_regime_score": stage_query(_upto("regime"), ["regime_score"]),
    "d25_regime_buckets": stage_query(_regime, ["regime_low", "regime_mid", "regime_high"]),
    "d26_regime_states": stage_query(
        _upto("regime"), ["state_momentum", "state_reversal", "state_pressure", "state_liquidity"]
    ),
    "d27_date_volatility": stage_query(lambda p: fx.date_volatility(p, fx.mid_returns(p, p.df.select(*p.carried(), "midpx"))), ["state_vol_cs"]),
    "d28_date_means": stage_query(_upto("regime"), ["state_spread_cs", "state_activity_cs"]),
    "d29_order_rates": stage_query(lambda p: p.df.withColumns(fx.micro_orders()), fx.micro_orders),
    "d30_book_shape": stage_query(lambda p: p.df.withColumns(fx.micro_book()), fx.micro_book),
    "d31_trade_prices": stage_query(lambda p: p.df.withColumns(fx.micro_trades()), fx.micro_trades),
    "d32_order_dynamics": stage_query(
        _upto("rx_micro"), ["rx_net_press_ema5", "rx_cxl_rate_ema5", "rx_obi_w_ema5", "rx_add_imb_chg"]
    ),
    "d33_microprice": stage_query(lambda p: fx.micro_static(p.df), fx.micro_shape),
    "d34_micro_zscores": stage_query(_upto("rx_micro"), [*fx.MICRO_ZSCORES, "rx2_net_press_ema12"]),
    "d35_realized_volatility": stage_query(_upto("rx_micro"), ["rx2_rvol12", "rx2_cxl_x_rvol"]),
    "d36_open_high_low": stage_query(lambda p: p.df.withColumns(fx.micro_prices()), fx.micro_prices),
    "d37_turnover_ratios": stage_query(lambda p: p.df.withColumns(fx.micro_turnover()), fx.micro_turnover),
    "d38_order_price_levels": stage_query(
        lambda p: p.df.withColumns(fx.micro_order_prices()), fx.micro_order_prices
    ),
    "d39_raw_channels": stage_query(lambda p: fx.raw_channels(p, p.df), fx.channel_names()),
    "d40_identity_channels": stage_query(_upto("base"), ["obi0", "spread", "trade_imb"]),
    "d41_sequence_lags": stage_query(
        lambda p: fx.sequence_lags(p, p.df, [1, 5]),
        [*fx.SEQUENCE_COLUMNS, *[f"{c}_seq_lag_{n}" for c in fx.SEQUENCE_COLUMNS for n in (1, 5)]],
    ),
}
