"""Feature catalogue: stages, the groups users ask for, and stage order."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from barspan.functions.scalars import KEYS, LABEL, clean
from barspan.operators import features as fx
from barspan.plans.tables import fresh_path, shuffles_dropped
from barspan.sources.bars import Panel

STATUSES = ("promoted", "candidate", "archived")
StageBuilder = Callable[[Panel, DataFrame], DataFrame]


@dataclass(frozen=True)
class Stage:
    name: str
    builder: StageBuilder
    columns: list[str]
    needs: tuple[str, ...] = ()
    status: str = "promoted"
    groups: dict[str, list[str]] = field(default_factory=dict)
    # A cheaper builder that leaves out the columns no other stage reads: the
    # exponential averages, whose long memory makes split series carry a long halo.
    core: StageBuilder | None = None
    beyond_core: tuple[str, ...] = ()
    # Looks along series only and no other stage reads it: built after the others, so its columns cross none of
    # their shuffles.
    last: bool = False

    def builder_for(self, columns: list[str] | None) -> StageBuilder:
        """``columns`` are those asked for; none when only other stages read it."""
        if self.core is None or set(columns or ()) & set(self.beyond_core):
            return self.builder
        return self.core


class Catalogue:
    def __init__(self, stages: Iterable[Stage] = ()):
        self.stages: dict[str, Stage] = {}
        for stage in stages:
            self.add(stage)

    def add(self, stage: Stage) -> None:
        if stage.status not in STATUSES:
            raise ValueError(f"unknown status {stage.status!r} of stage {stage.name}")
        if stage.name in self.stages:
            raise ValueError(f"stage {stage.name} is registered twice")
        self.stages[stage.name] = stage

    def order(self, with_archived: bool = False) -> list[str]:
        """Stages after their needs; ready stages keep the order they became ready in."""
        live = {n: s for n, s in self.stages.items() if with_archived or s.status != "archived"}
        for stage in live.values():
            for need in stage.needs:
                if need not in self.stages:
                    raise ValueError(f"stage {stage.name} needs unknown stage {need}")
                if need not in live:
                    raise ValueError(f"stage {stage.name} needs archived stage {need}")
        done = [n for n, s in live.items() if not s.needs]
        for current in done:
            ready = [
                n for n, s in live.items()
                if n not in done and current in s.needs and set(s.needs) <= set(done[: done.index(current) + 1])
            ]
            done.extend(ready)
        if len(done) != len(live):
            raise ValueError("the stages form a cycle")
        return done

    def downstream(self, name: str) -> set[str]:
        if name not in self.stages:
            raise KeyError(name)
        found, grew = {name}, True
        while grew:
            more = {s.name for s in self.stages.values() if set(s.needs) & found} - found
            found |= more
            grew = bool(more)
        return found - {name}

    def upstream(self, names: Iterable[str]) -> list[str]:
        """The given stages and everything they need, in stage order."""
        wanted, queue = set(), list(names)
        while queue:
            name = queue.pop()
            if name not in wanted:
                wanted.add(name)
                queue.extend(self.stages[name].needs)
        return [n for n in self.order() if n in wanted]

    def code_hash(self, name: str) -> str:
        """Hash of the builder and of all it reaches in this package: functions by their code, constants by value."""
        parts: dict[str, str] = {}
        _gather(self.stages[name].builder, parts)
        return hashlib.md5("\n".join(f"{k}={parts[k]}" for k in sorted(parts)).encode()).hexdigest()

    def resolve(self, groups: str | Iterable[str] | None = None) -> dict[str, list[str]]:
        """Columns per stage for the groups; none, empty and ``full`` mean everything."""
        names = [groups] if isinstance(groups, str) else [g for g in groups or [] if g]
        order = self.order()
        if not names or names == ["full"]:
            return {n: list(self.stages[n].columns) for n in order}
        picked: dict[str, dict[str, None]] = {}
        for group in names:
            holders = [n for n in order if group in self.stages[n].groups]
            if not holders:
                raise KeyError(f"unknown feature group: {group}")
            for n in holders:
                picked.setdefault(n, {}).update(dict.fromkeys(self.stages[n].groups[group]))
        return {n: list(columns) for n, columns in picked.items()}

    def columns(self, groups: str | Iterable[str] | None = None) -> list[str]:
        """Output columns in stage order, the first stage winning a shared name."""
        resolved = self.resolve(groups)
        names = [c for n in self.order() if n in resolved for c in resolved[n]]
        return list(dict.fromkeys(names))

    def with_stages(self, panel: Panel, names: Iterable[str] | dict[str, list[str]]) -> DataFrame:
        """Raw bars with the columns of the stages and of what they need."""
        wanted = names if isinstance(names, dict) else {n: self.stages[n].columns for n in names}
        df, names = panel.df, self.upstream(wanted)
        for n in [n for n in names if not self.stages[n].last]:
            df = self.stages[n].builder_for(wanted.get(n))(panel, df)
        late = [n for n in names if self.stages[n].last]
        if late:
            df = panel.dealt_series(df)
        for n in late:
            df = self.stages[n].builder_for(wanted.get(n))(panel, df)
        return df


PACKAGE = __name__.split(".")[0]


def _gather(function: Callable, parts: dict[str, str]) -> None:
    """Source of a function and, under their names, of the helpers and constants its code names."""
    function = inspect.unwrap(function)
    key = f"{function.__module__}.{function.__qualname__}"
    if key in parts:
        return
    parts[key] = inspect.getsource(function)
    names: set[str] = set()
    codes = [function.__code__]
    while codes:
        code = codes.pop()
        names.update(code.co_names)
        codes += [c for c in code.co_consts if inspect.iscode(c)]
    spaces = [function.__globals__]
    spaces += [vars(m) for n in names if inspect.ismodule(m := function.__globals__.get(n)) and m.__name__.startswith(PACKAGE)]
    for space in spaces:
        for n in names & set(space):
            value = space[n]
            if inspect.isfunction(value):
                if value.__module__.startswith(PACKAGE):
                    _gather(value, parts)
            elif isinstance(value, (str, int, float, tuple, list, dict, set, frozenset)) and not n.startswith("__"):
                parts[f"{space['__name__']}.{n}"] = repr(sorted(value) if isinstance(value, (set, frozenset)) else value)


def build_features(
    panel: Panel, groups: str | Iterable[str] | None = None, catalogue: Catalogue | None = None
) -> DataFrame:
    """Keys, cleaned label and the columns of the groups, from raw bars in one plan."""
    catalogue = catalogue or CATALOGUE
    df = catalogue.with_stages(panel, catalogue.resolve(groups))
    return df.select(*KEYS, clean(F.col(LABEL)).alias(LABEL), *catalogue.columns(groups))


#: Rows of the dates whose features are worked out together when a table of them is written.
STEP_ROWS = 500_000


def written_features(
    panel: Panel, groups: str | Iterable[str] | None = None, exact: Iterable[str] | None = None, catalogue: Catalogue | None = None
) -> DataFrame:
    """``build_features`` as a written table, for fits and scores that read it several times.

    Features never look across dates, so a large panel is written some dates after the other: what a step shuffles is
    gone before the next begins. ``exact`` names the feature columns that are kept as doubles where floats do
    for the others; by default all are.
    """

    def table(part: Panel) -> DataFrame:
        df = build_features(part, groups, catalogue)
        floats = [] if exact is None else [c for c in df.columns if c not in {*KEYS, LABEL, *exact}]
        return df.withColumns({c: F.col(c).cast("float") for c in floats}) if floats else df

    path, spark, schema = fresh_path(panel.spark, "features"), panel.spark, None
    with shuffles_dropped(spark):
        for days, rows in date_steps(panel):
            part = panel
            if days is not None:
                known = F.col("date").isin([d for d in days if d is not None])
                held = panel.df.where(known | F.col("date").isNull() if None in days else known)
                part = replace(panel, df=held, layout=replace(panel.layout, total_rows=rows))
            made = table(part)
            made.write.mode("append").option("compression", "zstd").parquet(path)
            schema = made.schema
    return spark.read.schema(schema).parquet(path)


def date_steps(panel: Panel, days: DataFrame | None = None) -> list[tuple[list[int | None] | None, int]]:
    """Dates of about STEP_ROWS rows, or a little less to make even steps, and their rows; None for all dates of a panel of fewer."""
    if panel.layout.total_rows <= STEP_ROWS:
        return [(None, panel.layout.total_rows)]
    rows = panel.df if days is None else panel.df.join(days, "date", "left_semi")
    counted = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n")).orderBy("date").collect()
    steps: list[tuple[list[int | None], int]] = []
    even = panel.layout.total_rows / -(-panel.layout.total_rows // STEP_ROWS)
    for day, n in counted:
        if not steps or steps[-1][1] + n / 2 > even:
            steps.append(([], 0))
        steps[-1] = [*steps[-1][0], day], steps[-1][1] + n
    return steps or [(None, 0)]


# -- the ten stages ---------------------------------------------------------------
# Column names, their order, and the groups they belong to.

LEGACY = ["ob_imb0", "ob_imb4", "ob_imb9", "trade_imb", "trade_imbema5", "lagret12"]
BASE_CORE = [
    "spread", "mid_ret1_raw", "obi0", "obi4", "obi9", "trade_imb", "trade_turnover_imb", "add_imb",
    "cxl_imb", "qty_add_imb", "qty_cxl_imb", "buy_vwad_gap", "sell_vwad_gap", "trade_activity",
    "order_pressure",
]
BASE = [
    "spread", "mid_ret1_raw", "obi0", "obi4", "obi9", "trade_imb", "trade_imbema5",
    "trade_turnover_imb", "add_imb", "cxl_imb", "qty_add_imb", "qty_cxl_imb", "buy_vwad_gap",
    "sell_vwad_gap", "bret12", "lagret12", "ob_imb0", "ob_imb4", "ob_imb9", "trade_activity",
    "order_pressure",
]
LEVELS = list(fx.BOOK_LEVELS)
OFI_RAW = [f"{side}ofi_{v}" for v in LEVELS for side in ("bid_", "ask_", "")] + ["ofi_total"]
OFI_DYNAMIC = [f"ofi_total_{kind}{w}" for kind in ("ema", "sum", "mean", "z") for w in fx.FLOW_WINDOWS]
OFI = (
    [
        name
        for v in LEVELS
        for name in (
            f"bid_ofi_{v}", f"ask_ofi_{v}", f"ofi_{v}", f"ofi_{v}_depth", f"ofi_{v}_div_depth",
            f"ofi_{v}_div_turnover",
        )
    ]
    + ["ofi_total", "ofi_total_depth", "ofi_abs", "ofi_sign", "ofi_div_total_depth", "ofi_div_turnover"]
    + [f"ofi_total_{kind}{w}" for w in fx.FLOW_WINDOWS for kind in ("ema", "sum", "mean", "z")]
)
LAG = [f"{c}_lag_{n}" for n in fx.LAG_STEPS for c in ("mid_ret", "obi0", "trade_imb", "spread")]
ROLL = [f"{c}_{kind}{w}" for w in fx.ROLL_WINDOWS for c in fx.ROLL_COLUMNS for kind in ("rm", "rs")]
PATCH = [
    f"{c}_patch{w}_{kind}"
    for c in fx.PATCH_COLUMNS
    for w in fx.PATCH_WINDOWS
    for kind in ("mean", "std", "max", "min", "range", "slope", "last")
]
IMPACT_INTERACTION = [
    "trade_pressure_x_spread", "trade_pressure_x_order_pressure", "trade_pressure_x_ofi",
]
IMPACT_DYNAMIC = [
    f"{c}_{kind}{w}" for w in fx.FLOW_WINDOWS for c in fx.IMPACT_COLUMNS for kind in ("ema", "sum", "mean", "z")
]
IMPACT = (
    ["signed_trade_qty", "signed_trade_turnover", *fx.IMPACT_COLUMNS, *IMPACT_INTERACTION] + IMPACT_DYNAMIC
)
CROSS_Z = [f"{c}_cs_z" for c in fx.CROSS_SOURCES]
CROSS_RANK = [f"{c}_cs_rank" for c in fx.CROSS_SOURCES]
CROSS = CROSS_Z + CROSS_RANK + ["interval_pos", "interval_norm", "is_morning", "is_afternoon"]
MOMENTUM = [
    f"lagret{w}{kind}"
    for w in fx.MOMENTUM_WINDOWS
    for kind in ("_raw", "", "_abs", "_sign", "_x_trade_pressure", "_x_ofi", "_x_spread", "_x_vol")
] + ["momentum_state", "reversal_state", "conditional_momentum_rank"]
REGIME = [
    "regime_score", "regime_low", "regime_mid", "regime_high", "state_momentum", "state_reversal",
    "state_pressure", "state_liquidity", "state_vol_cs", "state_spread_cs", "state_activity_cs",
]
RX_MICRO = [
    "rx_cxl_rate_cnt", "rx_cxl_rate_qty", "rx_add_imb_to", "rx_cxl_imb_to", "rx_net_order_press",
    "rx_add_vs_trade", "rx_cxl_vs_trade", "rx_obi19", "rx_obi_weighted", "rx_depth_nf_bid",
    "rx_depth_nf_ask", "rx_spread_deep_rel", "rx_vwad_gap_buy", "rx_vwad_gap_sell",
    "rx_trade_range_buy", "rx_trade_range_sell", "rx_net_press_ema5", "rx_cxl_rate_ema5",
    "rx_obi_w_ema5", "rx_add_imb_chg", "rx2_microprice_dev", "rx2_depth_imb_all", "rx2_conc_bid",
    "rx2_conc_ask", "rx2_obi_term", "rx2_spread_rel", "rx2_press_x_tradeimb", "rx2_net_press_z12",
    "rx2_obi_w_z12", "rx2_cxl_rate_z12", "rx2_micro_dev_z12", "rx2_net_press_ema12", "rx2_rvol12",
    "rx2_cxl_x_rvol", "rx3_lastpx_dev", "rx3_hl_range", "rx3_oc_ret", "rx3_to_imb_04",
    "rx3_to_imb_59", "rx3_to_imb_1019", "rx3_to_imb_all", "rx3_to_nf_b", "rx3_to_nf_a",
    "rx3_addbuy_range", "rx3_addsell_range", "rx3_addbuy_lvl", "rx3_addsell_lvl", "rx3_cxlbuy_lvl",
    "rx3_cxlsell_lvl",
]


def _holding(columns: list[str], *parts: str) -> list[str]:
    """Columns containing one of the parts. Substrings match on purpose: the short
    lag group also holds lags 10 and 30, the short roll group also window 30."""
    return [c for c in columns if any(p in c for p in parts)]


def _starting(columns: list[str], *prefixes: str) -> list[str]:
    return [c for c in columns if c.startswith(prefixes)]


_FLOW_CROSS = ("trade_pressure_", "trade_intensity", "avg_trade_")
_CROSS_IMPACT = _starting(CROSS_Z + CROSS_RANK, *_FLOW_CROSS)
_CROSS_OFI = _starting(CROSS_Z + CROSS_RANK, "ofi_")

CATALOGUE = Catalogue(
    [
        Stage(
            "base", fx.base, BASE,
            groups={"legacy": LEGACY, "base": BASE_CORE, "norm_core": BASE_CORE},
            core=fx.base_core, beyond_core=("trade_imbema5",),
        ),
        Stage(
            "ofi", fx.ofi, OFI,
            groups={"ofi": OFI, "ofi_raw": OFI_RAW, "ofi_dynamic": OFI_DYNAMIC, "ofi_safe": OFI},
            core=fx.ofi_levels, beyond_core=tuple(OFI_DYNAMIC),
        ),
        Stage(
            "lag", fx.lag, LAG, ("base",),
            groups={
                "lag": LAG,
                "lag_short": _holding(LAG, "_lag_1", "_lag_3", "_lag_5"),
                "lag_mid": _holding(LAG, "_lag_10"),
                "lag_long": _holding(LAG, "_lag_20", "_lag_30"),
            },
            last=True,
        ),
        Stage(
            "roll", fx.roll, ROLL, ("base",),
            groups={
                "roll": ROLL,
                "roll_short": _holding(ROLL, "_rm3", "_rm5", "_rs3", "_rs5"),
                "roll_mid": _holding(ROLL, "_rm10", "_rs10"),
                "roll_long": _holding(ROLL, "_rm20", "_rm30", "_rs20", "_rs30"),
            },
            last=True,
        ),
        Stage("patch", fx.patch, PATCH, ("base",), groups={"patch": PATCH, "patch_summary": PATCH}, last=True),
        Stage(
            "trade_impact", fx.trade_impact, IMPACT, ("base", "ofi"),
            groups={
                "trade_impact": IMPACT,
                "trade_impact_dyn": IMPACT_DYNAMIC,
                "trade_impact_interaction": IMPACT_INTERACTION,
                "trade_impact_safe": IMPACT,
            },
            core=fx.impact_levels, beyond_core=tuple(IMPACT_DYNAMIC),
        ),
        Stage(
            "cross", fx.cross, CROSS, ("base", "ofi", "trade_impact"),
            groups={
                "cross_z": CROSS_Z,
                "cross_rank": CROSS_RANK,
                "cross_rank_features": CROSS_RANK,
                "norm_core": CROSS_Z,
                "cross": CROSS,
                "ofi": _CROSS_OFI,
                "ofi_dynamic": _starting(CROSS_Z, "ofi_"),
                "ofi_rank": _starting(CROSS_RANK, "ofi_"),
                "ofi_safe": _CROSS_OFI,
                "trade_impact": _CROSS_IMPACT,
                "trade_impact_dyn": _CROSS_IMPACT,
                "trade_impact_safe": _CROSS_IMPACT,
            },
        ),
        Stage(
            "conditional_momentum", fx.conditional_momentum, MOMENTUM, ("base", "ofi", "trade_impact"),
            groups={
                "conditional_momentum": MOMENTUM,
                "conditional_momentum_interaction": [c for c in MOMENTUM if "_x_" in c],
                "conditional_momentum_safe": MOMENTUM,
            },
        ),
        Stage(
            "regime", fx.regime, REGIME, ("base",),
            groups={
                "regime": REGIME,
                "regime_tree": [c for c in REGIME if c not in ("state_spread_cs", "state_activity_cs")],
            },
        ),
        Stage("rx_micro", fx.rx_micro, RX_MICRO, groups={"rx_micro": RX_MICRO}),
    ]
)
