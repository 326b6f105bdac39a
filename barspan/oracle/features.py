"""Feature stages as SQL."""

from __future__ import annotations

from barspan.oracle import bars as _bars  # noqa: F401  registers the bars view
from barspan.oracle.text import (
    P,
    change,
    cl,
    columns,
    cte,
    da,
    de,
    ema,
    f32,
    fl,
    imb,
    imbe,
    lag,
    last,
    mean,
    query,
    q,
    rank,
    show,
    snap,
    std,
    zscore,
)

SQL: dict[str, str] = {}

LEVELS = {"0": ("bid0", "ask0", "bsize0", "asize0"), "4": ("bid4", "ask4", "bsize0_4", "asize0_4"),
          "9": ("bid9", "ask9", "bsize5_9", "asize5_9"), "19": ("bid19", "ask19", "bsize10_19", "asize10_19")}
FLOW = [3, 6, 12, 24]
IMPACT = ["trade_pressure_qty", "trade_pressure_turnover", "trade_intensity", "avg_trade_size", "avg_trade_turnover"]
CROSS = ["midpx", "spread", "obi0", "obi4", "trade_imb", "order_pressure", "trade_activity", "ofi_total", "ofi_0",
         "ofi_4", "ofi_9", "ofi_19", *IMPACT]

# base
SHAPE = {"spread": cl("(ask0 - bid0)"), "buy_vwad_gap": cl("(buyVwad - midpx)"), "sell_vwad_gap": cl("(sellVwad - midpx)")}
BOOK = {"obi0": cl(imb("asize0", "bsize0")), "obi4": cl(imb("asize0_4", "bsize0_4")), "obi9": cl(imb("asize5_9", "bsize5_9"))}
BOOK |= {f"ob_imb{d}": BOOK[f"obi{d}"] for d in "049"}
FLOWS = {
    "trade_imb": cl(imb("tradeBuyQty", "tradeSellQty")),
    "trade_turnover_imb": cl(imb("tradeBuyTurnover", "tradeSellTurnover")),
    "add_imb": cl(imb("nAddBuy", "nAddSell")),
    "cxl_imb": cl(imb("nCxlBuy", "nCxlSell")),
    "qty_add_imb": cl(imb("addBuyQty", "addSellQty")),
    "qty_cxl_imb": cl(imb("cxlBuyQty", "cxlSellQty")),
}
TRADED = "(nTradeBuy + nTradeSell + tradeBuyQty + tradeSellQty)"
cte("base0", "bars", f"SELECT *, {columns(SHAPE | BOOK | FLOWS)} FROM bars")
cte("base1", "base0", f"""SELECT *, {TRADED} AS trade_activity, obi0 + 0.5 * obi4 + 0.5 * trade_imb AS order_pressure,
  {change(1)} AS mid_ret1_raw, {change(12)} AS bret12,
  CAST(row_number() OVER ({P}) - 1 AS DOUBLE) AS k FROM base0""")
cte("base", "base1", f"""SELECT *, {ema('trade_imb', 5)} AS trade_imbema5,
  {snap('bret12 - avg(bret12) OVER (PARTITION BY date, bar)')} AS lagret12 FROM base1""")
SQL["d01_spread_and_gaps"] = show("base0", SHAPE)
SQL["d02_book_imbalance"] = show("base0", BOOK)
SQL["d03_flow_imbalance"] = show("base0", FLOWS)
SQL["d04_mid_return"] = show("base1", ["mid_ret1_raw"])
SQL["d05_trade_imbalance_ema"] = show("base", ["trade_imbema5"])
SQL["d06_lagged_return"] = show("base", ["bret12", "lagret12"])
SQL["d07_activity_and_pressure"] = show("base1", ["trade_activity", "order_pressure"])

# lag, roll, patch
LAGS = {}
for n in (1, 3, 5, 10, 20, 30):
    LAGS[f"mid_ret_lag_{n}"] = change(n)
    LAGS |= {f"{c}_lag_{n}": f"coalesce({lag(c, n)}, 0.0)" for c in ("obi0", "trade_imb", "spread")}
cte("lags", "base", f"SELECT *, {columns(LAGS)} FROM base")
SQL["d08_lags"] = show("lags", LAGS)
ROLLS = {}
for w in (3, 5, 10, 20, 30):
    for c in ("mid_ret1_raw", "obi0", "trade_imb", "order_pressure", "spread"):
        ROLLS |= {f"{c}_rm{w}": cl(f"({mean(c, w)})"), f"{c}_rs{w}": cl(f"({std(c, w)})")}
cte("rolls", "base", f"SELECT *, {columns(ROLLS)} FROM base")
SQL["d09_rolling"] = show("rolls", ROLLS)
PATCHED = ("mid_ret1_raw", "obi0", "trade_imb", "spread", "order_pressure")
cte("steps", "base", "SELECT *, " + ", ".join(f"{c} - {lag(c)} AS step_{c}" for c in PATCHED) + " FROM base")
PATCH = {}
for c in PATCHED:
    for w in (6, 12, 24, 60):
        hi, lo = f"max({c}) OVER {last(w)}", f"min({c}) OVER {last(w)}"
        PATCH |= {
            f"{c}_patch{w}_mean": mean(c, w),
            f"{c}_patch{w}_std": std(c, w),
            f"{c}_patch{w}_max": hi,
            f"{c}_patch{w}_min": lo,
            f"{c}_patch{w}_range": f"{hi} - {lo}",
            f"{c}_patch{w}_slope": f"coalesce({mean('step_' + c, w)}, 0.0)",
            f"{c}_patch{w}_last": c,
        }
cte("patches", "steps", f"SELECT *, {columns(PATCH)} FROM steps")
SQL["d10_patches"] = show("patches", PATCH)

# order flow
FLOW_LEVEL = {}
for v, (bid, ask, bs, as_) in LEVELS.items():
    FLOW_LEVEL[f"bid_ofi_{v}"] = (
        f"coalesce(CASE WHEN {bid} > {lag(bid)} THEN {bs} WHEN {bid} = {lag(bid)} THEN {bs} - {lag(bs)} "
        f"ELSE -({lag(bs)}) END, 0.0)"
    )
    FLOW_LEVEL[f"ask_ofi_{v}"] = (
        f"coalesce(CASE WHEN {ask} < {lag(ask)} THEN -{as_} WHEN {ask} = {lag(ask)} THEN -({as_} - {lag(as_)}) "
        f"ELSE {lag(as_)} END, 0.0)"
    )
cte("ofi0", "bars", f"""SELECT *, {columns(FLOW_LEVEL)}, tradeBuyTurnover + tradeSellTurnover AS turnover,
  CAST(row_number() OVER ({P}) - 1 AS DOUBLE) AS k FROM bars""")
cte("ofi1", "ofi0", "SELECT *, " + columns(
    {f"ofi_{v}": f"bid_ofi_{v} + ask_ofi_{v}" for v in LEVELS}
    | {f"ofi_{v}_depth": f"{b} + {a}" for v, (_, _, b, a) in LEVELS.items()}) + " FROM ofi0")
RATIOS = {f"ofi_{v}_div_depth": da(f"ofi_{v}", f"ofi_{v}_depth") for v in LEVELS}
RATIOS |= {f"ofi_{v}_div_turnover": da(f"ofi_{v}", "turnover") for v in LEVELS}
cte("ofi2", "ofi1", f"""SELECT *, {columns(RATIOS)}, ofi_0 + ofi_4 + ofi_9 + ofi_19 AS ofi_total,
  ofi_0_depth + ofi_4_depth + ofi_9_depth + ofi_19_depth AS ofi_total_depth FROM ofi1""")
TOTALS = {"ofi_abs": "abs(ofi_total)", "ofi_sign": "CAST(sign(ofi_total) AS DOUBLE)",
          "ofi_div_total_depth": da("ofi_total", "ofi_total_depth"), "ofi_div_turnover": da("ofi_total", "turnover")}
cte("ofi", "ofi2", f"SELECT *, {columns(TOTALS)} FROM ofi2")


def dynamics(names: list[str]) -> dict[str, str]:
    out = {}
    for c in names:
        for w in FLOW:
            out |= {
                f"{c}_ema{w}": ema(c, w),
                f"{c}_sum{w}": f"sum({c}) OVER {last(w)}",
                f"{c}_mean{w}": mean(c, w),
                f"{c}_z{w}": zscore(c, w, "1e-8"),
            }
    return out


OFI_DYN = dynamics(["ofi_total"])
cte("ofi_dyn", "ofi", f"SELECT *, {columns(OFI_DYN)} FROM ofi")
SQL["d11_order_flow_levels"] = show("ofi1", [f"{s}ofi_{v}" for v in LEVELS for s in ("bid_", "ask_", "")])
SQL["d12_order_flow_ratios"] = show("ofi2", [f"ofi_{v}_depth" for v in LEVELS] + list(RATIOS))
SQL["d13_order_flow_totals"] = show("ofi", ["ofi_total", "ofi_total_depth", *TOTALS])
SQL["d14_order_flow_dynamics"] = show("ofi_dyn", OFI_DYN)

# trade impact, over base and order flow together
cte("base_ofi", ("base", "ofi"), "SELECT base.*, " + ", ".join(
    [f"o.{c}" for c in ("turnover", "ofi_total", "ofi_total_depth", *[f"ofi_{v}" for v in LEVELS])])
    + " FROM base JOIN ofi o USING (date, symbol, bar)")
STATIC = {
    "signed_trade_qty": "tradeBuyQty - tradeSellQty",
    "signed_trade_turnover": "tradeBuyTurnover - tradeSellTurnover",
    "trade_pressure_qty": da("tradeBuyQty - tradeSellQty", "tradeBuyQty + tradeSellQty"),
    "trade_pressure_turnover": da("tradeBuyTurnover - tradeSellTurnover", "turnover"),
    "trade_intensity": "nTradeBuy + nTradeSell",
    "avg_trade_size": da("tradeBuyQty + tradeSellQty", "nTradeBuy + nTradeSell"),
    "avg_trade_turnover": da("turnover", "nTradeBuy + nTradeSell"),
}
cte("impact0", "base_ofi", f"SELECT *, {columns(STATIC)} FROM base_ofi")
INTERACT = {"trade_pressure_x_spread": "trade_pressure_qty * spread",
            "trade_pressure_x_order_pressure": "trade_pressure_qty * order_pressure",
            "trade_pressure_x_ofi": "trade_pressure_qty * ofi_total"}
cte("impact", "impact0", f"SELECT *, {columns(INTERACT)} FROM impact0")
IMPACT_DYN = dynamics(IMPACT)
cte("impact_dyn", "impact", f"SELECT *, {columns(IMPACT_DYN)} FROM impact")
SQL["d15_trade_impact"] = show("impact", STATIC)
SQL["d16_trade_impact_interactions"] = show("impact", INTERACT)
SQL["d17_trade_impact_dynamics"] = show("impact_dyn", IMPACT_DYN)

# cross-section
X = "PARTITION BY date, bar"
CROSS_Z = {
    f"{c}_cs_z": f"coalesce(CASE WHEN max(f_{c}) OVER ({X}) = min(f_{c}) OVER ({X}) THEN 0.0 ELSE "
    f"(f_{c} - avg(f_{c}) OVER ({X})) / nullif(stddev_samp(f_{c}) OVER ({X}), 0) END, 0.0)"
    for c in CROSS
}
CROSS_RANK = {f"{c}_cs_rank": rank(f"f_{c}", "date, bar") for c in CROSS}
cte("cross_z", "cross_f", f"SELECT *, {columns(CROSS_Z)} FROM cross_f")
cte("cross_f", "impact", "SELECT *, " + columns({f"f_{c}": f32(c) for c in CROSS}) + " FROM impact")
cte("cross_rank", "cross_f", f"SELECT *, {columns(CROSS_RANK)} FROM cross_f")
cte("clock", "bars", f"""SELECT date, symbol, bar, {rank('bar', 'date')} AS interval_pos, bar / 1e8 AS interval_norm,
  {fl('bar < 113000000')} AS is_morning, {fl('bar >= 130000000')} AS is_afternoon FROM bars""")
SQL["d18_cross_zscores"] = show("cross_z", CROSS_Z)
SQL["d19_cross_ranks"] = show("cross_rank", CROSS_RANK)
SQL["d20_time_of_day"] = show("clock", ["interval_pos", "interval_norm", "is_morning", "is_afternoon"])

# momentum
MOM = [1, 3, 6, 12, 24]
cte("mom0", "impact", "SELECT *, " + columns(
    {f"lagret{w}_raw": change(w) for w in MOM}
    | {f"vol{w}": std("mid_ret1_raw", min(10, w + 2)) for w in MOM}) + " FROM (SELECT * EXCLUDE (lagret12) FROM impact)")
cte("mom1", "mom0", "SELECT *, " + columns(
    {f"lagret{w}": snap(f"lagret{w}_raw - avg(lagret{w}_raw) OVER ({X})") for w in MOM}) + " FROM mom0")
MOM_RET = [f"lagret{w}{k}" for w in MOM for k in ("_raw", "", "_abs", "_sign")]
MOM_X = {}
for w in MOM:
    pairs = {"trade_pressure": "trade_pressure_qty", "ofi": "ofi_total", "spread": "spread", "vol": f"vol{w}"}
    MOM_X |= {f"lagret{w}_x_{n}": f"lagret{w} * {c}" for n, c in pairs.items()}
cte("mom", "mom1", "SELECT *, " + columns(
    {f"lagret{w}_abs": f"abs(lagret{w})" for w in MOM}
    | {f"lagret{w}_sign": f"CAST(sign(lagret{w}) AS DOUBLE)" for w in MOM} | MOM_X
    | {"momentum_state": fl("lagret12 > 0"), "reversal_state": fl("lagret12 < 0"),
       "f_lagret12": f32("lagret12")}) + " FROM mom1")
cte("mom_rank", "mom", f"SELECT *, {rank('f_lagret12', 'date')} AS conditional_momentum_rank FROM mom")
SQL["d21_momentum_returns"] = show("mom", MOM_RET)
SQL["d22_momentum_interactions"] = show("mom", MOM_X)
SQL["d23_momentum_states"] = show("mom_rank", ["momentum_state", "reversal_state", "conditional_momentum_rank"])

# regime
cte("reg0", "base", f"""SELECT *, {snap('coalesce(' + std('mid_ret1_raw', 10) + ', 0.0)')} AS vol10,
  avg(spread) OVER (PARTITION BY date) AS state_spread_cs,
  avg(trade_activity) OVER (PARTITION BY date) AS state_activity_cs,
  stddev_pop(mid_ret1_raw) OVER (PARTITION BY date ORDER BY symbol, bar ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
    AS state_vol_cs FROM base""")
cte("reg1", "reg0", f"""SELECT *, {snap('''0.35 * (vol10 / coalesce(nullif(avg(vol10) OVER (PARTITION BY date), 0), 1.0))
  + 0.25 * spread + 0.20 * abs(order_pressure) + 0.10 * trade_activity + 0.10 * abs(cxl_imb)''', 9)} AS regime_score,
  {snap('spread', 9)} AS s9, {snap('order_pressure', 9)} AS p9, {snap('abs(order_pressure)', 9)} AS a9 FROM reg0""")
cte("reg_cut", "reg1", """SELECT date, quantile_cont(regime_score, 0.33) AS lo, quantile_cont(regime_score, 0.66) AS hi,
  quantile_cont(vol10, 0.5) AS vol_mid, quantile_cont(s9, 0.5) AS spread_mid, quantile_cont(p9, 0.5) AS pressure_mid
  FROM reg1 GROUP BY date""")
STATES = {
    "regime_low": fl("regime_score <= lo"),
    "regime_mid": fl("regime_score > lo AND regime_score <= hi"),
    "regime_high": fl("regime_score > hi"),
    "state_momentum": fl("mid_ret1_raw > 0 AND vol10 < vol_mid"),
    "state_reversal": fl("mid_ret1_raw < 0 AND s9 > spread_mid"),
    "state_pressure": fl("a9 > abs(pressure_mid)"),
    "state_liquidity": fl("trade_activity < state_activity_cs"),
}
cte("reg", ("reg1", "reg_cut"), f"SELECT *, {columns(STATES)} FROM reg1 JOIN reg_cut USING (date)")
SQL["d24_regime_score"] = show("reg", ["regime_score"])
SQL["d25_regime_buckets"] = show("reg", ["regime_low", "regime_mid", "regime_high"])
SQL["d26_regime_states"] = show("reg", ["state_momentum", "state_reversal", "state_pressure", "state_liquidity"])
SQL["d27_date_volatility"] = show("reg0", ["state_vol_cs"])
SQL["d28_date_means"] = show("reg0", ["state_spread_cs", "state_activity_cs"])

# micro-structure extras
MID = "(CASE WHEN abs(midpx) >= 1e-9 THEN midpx END)"


def rel(x: str) -> str:
    return cl(de(x, MID))


def l1p(a: str, b: str) -> str:
    r = de(a, b)
    return cl(f"(CASE WHEN {r} > -1 THEN ln(1 + {r}) END)")


ORDERS = {
    "rx_cxl_rate_cnt": cl(de("nCxlBuy + nCxlSell", "nAddBuy + nAddSell")),
    "rx_cxl_rate_qty": cl(de("cxlBuyQty + cxlSellQty", "addBuyQty + addSellQty")),
    "rx_add_imb_to": cl(imbe("addBuyTurnover", "addSellTurnover")),
    "rx_cxl_imb_to": cl(imbe("cxlBuyTurnover", "cxlSellTurnover")),
    "rx_net_order_press": cl(f"({imbe('nAddBuy', 'nAddSell')} - {imbe('nCxlBuy', 'nCxlSell')})"),
    "rx_add_vs_trade": l1p("nAddBuy + nAddSell", "nTradeBuy + nTradeSell"),
    "rx_cxl_vs_trade": l1p("nCxlBuy + nCxlSell", "nTradeBuy + nTradeSell"),
}
OB = [imbe("asize0", "bsize0"), imbe("asize0_4", "bsize0_4"), imbe("asize5_9", "bsize5_9"), imbe("asize10_19", "bsize10_19")]
RXBOOK = {
    "rx_obi19": cl(OB[3]),
    "rx_obi_weighted": cl(f"(0.4 * {OB[0]} + 0.3 * {OB[1]} + 0.2 * {OB[2]} + 0.1 * {OB[3]})"),
    "rx_depth_nf_bid": l1p("bsize0_4", "bsize10_19"),
    "rx_depth_nf_ask": l1p("asize0_4", "asize10_19"),
    "rx_spread_deep_rel": rel("(ask4 - bid4) - (ask0 - bid0)"),
}
RXTRADE = {
    "rx_vwad_gap_buy": rel("buyVwad - midpx"),
    "rx_vwad_gap_sell": rel("sellVwad - midpx"),
    "rx_trade_range_buy": rel("tradeBuyHigh - tradeBuyLow"),
    "rx_trade_range_sell": rel("tradeSellHigh - tradeSellLow"),
}
RXPRICE = {
    "rx3_lastpx_dev": rel("lastpx - midpx"),
    "rx3_hl_range": rel("high - low"),
    "rx3_oc_ret": cl(de("midpx - open", "(CASE WHEN abs(open) >= 1e-9 THEN open END)")),
}
BT, AT = "btr0_4 + btr5_9 + btr10_19", "atr0_4 + atr5_9 + atr10_19"
RXTURN = {
    "rx3_to_imb_04": cl(imbe("btr0_4", "atr0_4")),
    "rx3_to_imb_59": cl(imbe("btr5_9", "atr5_9")),
    "rx3_to_imb_1019": cl(imbe("btr10_19", "atr10_19")),
    "rx3_to_imb_all": cl(de(f"({BT}) - ({AT})", f"{BT} + {AT}")),
    "rx3_to_nf_b": l1p("btr0_4", "btr10_19"),
    "rx3_to_nf_a": l1p("atr0_4", "atr10_19"),
}
RXLEVEL = {
    "rx3_addbuy_range": rel("addBuyHigh - addBuyLow"),
    "rx3_addsell_range": rel("addSellHigh - addSellLow"),
    "rx3_addbuy_lvl": rel("addBuyHigh - midpx"),
    "rx3_addsell_lvl": rel("addSellLow - midpx"),
    "rx3_cxlbuy_lvl": rel("cxlBuyHigh - midpx"),
    "rx3_cxlsell_lvl": rel("cxlSellLow - midpx"),
}
TB, TA = "(bsize0 + bsize0_4 + bsize5_9 + bsize10_19)", "(asize0 + asize0_4 + asize5_9 + asize10_19)"
RXSHAPE = {
    "rx2_microprice_dev": rel(f"{de('bid0 * asize0 + ask0 * bsize0', 'asize0 + bsize0')} - midpx"),
    "rx2_depth_imb_all": cl(de(f"{TB} - {TA}", f"{TB} + {TA}")),
    "rx2_conc_bid": cl(de("bsize0", TB)),
    "rx2_conc_ask": cl(de("asize0", TA)),
    "rx2_obi_term": cl(f"({OB[3]} - {OB[0]})"),
    "rx2_spread_rel": rel("ask0 - bid0"),
    "rx2_press_x_tradeimb": cl(f"(rx_net_order_press * {imbe('tradeBuyQty', 'tradeSellQty')})"),
}
cte("rx0", "bars", f"""SELECT *, {columns(ORDERS | RXBOOK | RXTRADE | RXPRICE | RXTURN | RXLEVEL)},
  {imbe('nAddBuy', 'nAddSell')} AS raw_add_imb, ln(greatest(midpx, 1e-9)) AS log_mid,
  CAST(row_number() OVER ({P}) - 1 AS DOUBLE) AS k FROM bars""")
cte("rx1", "rx0", f"SELECT *, {columns(RXSHAPE)}, coalesce(log_mid - {lag('log_mid')}, 0.0) AS log_ret FROM rx0")
RXEMA = {
    "rx_net_press_ema5": ema("rx_net_order_press", 5),
    "rx_cxl_rate_ema5": ema("rx_cxl_rate_cnt", 5),
    "rx_obi_w_ema5": ema("rx_obi_weighted", 5),
    "rx_add_imb_chg": f"coalesce(raw_add_imb - {lag('raw_add_imb')}, 0.0)",
}
RXZ = {
    "rx2_net_press_z12": zscore("rx_net_order_press", 12, "1e-9", 2),
    "rx2_obi_w_z12": zscore("rx_obi_weighted", 12, "1e-9", 2),
    "rx2_cxl_rate_z12": zscore("rx_cxl_rate_cnt", 12, "1e-9", 2),
    "rx2_micro_dev_z12": zscore("rx2_microprice_dev", 12, "1e-9", 2),
}
RXZ = {n: f"coalesce({e}, 0.0)" for n, e in RXZ.items()} | {"rx2_net_press_ema12": ema("rx_net_order_press", 12)}
cte("rx2", "rx1", f"""SELECT *, {columns(RXEMA | RXZ)},
  coalesce(CASE WHEN count(log_ret) OVER {last(12)} >= 2 THEN {std('log_ret', 12)} END, 0.0) AS rx2_rvol12 FROM rx1""")
cte("rx", "rx2", "SELECT *, rx_cxl_rate_cnt * rx2_rvol12 AS rx2_cxl_x_rvol FROM rx2")
SQL["d29_order_rates"] = show("rx0", ORDERS)
SQL["d30_book_shape"] = show("rx0", RXBOOK)
SQL["d31_trade_prices"] = show("rx0", RXTRADE)
SQL["d32_order_dynamics"] = show("rx2", RXEMA)
SQL["d33_microprice"] = show("rx1", RXSHAPE)
SQL["d34_micro_zscores"] = show("rx2", RXZ)
SQL["d35_realized_volatility"] = show("rx", ["rx2_rvol12", "rx2_cxl_x_rvol"])
SQL["d36_open_high_low"] = show("rx0", RXPRICE)
SQL["d37_turnover_ratios"] = show("rx0", RXTURN)
SQL["d38_order_price_levels"] = show("rx0", RXLEVEL)

# raw channels
PRICES = ["lastpx", "open", "high", "low", "bid0", "ask0", "bid4", "ask4", "bid9", "ask9", "bid19", "ask19",
          "tradeBuyHigh", "tradeBuyLow", "buyVwad", "tradeSellHigh", "tradeSellLow", "sellVwad", "addBuyHigh",
          "addBuyLow", "addSellHigh", "addSellLow", "cxlBuyHigh", "cxlBuyLow", "cxlSellHigh", "cxlSellLow"]
VOLUMES = ["bsize0", "asize0", "bsize0_4", "asize0_4", "bsize5_9", "asize5_9", "bsize10_19", "asize10_19",
           "nTradeBuy", "tradeBuyQty", "tradeBuyTurnover", "nTradeSell", "tradeSellQty", "tradeSellTurnover",
           "nAddBuy", "addBuyQty", "addBuyTurnover", "nAddSell", "addSellQty", "addSellTurnover",
           "nCxlBuy", "cxlBuyQty", "cxlBuyTurnover", "nCxlSell", "cxlSellQty", "cxlSellTurnover"]
TRATIOS = ["btr0_4", "atr0_4", "btr5_9", "atr5_9", "btr10_19", "atr10_19"]
CHANNELS = {"midpx_logret": f"coalesce(ln(midpx) - {lag('ln(midpx)')}, 0.0)"}
CHANNELS |= {f"{c}_rel": cl(f"(CASE WHEN {c} > 0 THEN {c} / midpx - 1 ELSE 0.0 END)") for c in PRICES}
CHANNELS |= {f"{c}_log": f"ln(1 + greatest({c}, 0.0))" for c in VOLUMES}
cte("channels", "bars", f"SELECT date, symbol, bar, {columns(CHANNELS | {c: c for c in TRATIOS})} FROM bars")
SQL["d39_raw_channels"] = show("channels", [*CHANNELS, *TRATIOS])
SQL["d40_identity_channels"] = show("base", ["obi0", "spread", "trade_imb"])
SEQ = ["midpx", "bid0", "ask0", "bid4", "ask4", "bid9", "ask9", "bsize0", "asize0", "bsize0_4", "asize0_4", "bsize5_9",
       "asize5_9", "tradeBuyQty", "tradeSellQty", "tradeBuyTurnover", "tradeSellTurnover", "nAddBuy", "nAddSell",
       "nCxlBuy", "nCxlSell", "buyVwad", "sellVwad"]
SEQ_LAGS = {f"{c}_seq_lag_{n}": f"coalesce({lag(c, n)}, 0.0)" for c in SEQ for n in (1, 5)}
cte("seq", "bars", f"SELECT date, symbol, bar, {columns({c: f'coalesce({c}, 0.0)' for c in SEQ} | SEQ_LAGS)} FROM bars")
SQL["d41_sequence_lags"] = show("seq", [*SEQ, *SEQ_LAGS])

# groups built together
RIDGE_SET = ["ob_imb0", "ob_imb4", "ob_imb9", "trade_imb", "trade_imbema5", "lagret12", "spread", "mid_ret1_raw",
             "order_pressure"]
cte("group_set", ("base", "cross_z"), "SELECT base.*, " + ", ".join(f"c.{c}_cs_z" for c in CROSS)
    + " FROM base JOIN cross_z c USING (date, symbol, bar)")

__all__ = ["SQL", "query", "q"]
