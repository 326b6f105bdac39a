import pytest

from barspan.plans.catalogue import CATALOGUE, Catalogue, Stage


def test_order_and_sizes():
    assert CATALOGUE.order() == [
        "base", "ofi", "rx_micro", "lag", "roll", "patch", "regime", "trade_impact", "cross", "conditional_momentum",
    ]
    sizes = {n: len(s.columns) for n, s in CATALOGUE.stages.items()}
    assert sizes == {
        "base": 21, "ofi": 46, "lag": 24, "roll": 50, "patch": 140, "trade_impact": 90, "cross": 38,
        "conditional_momentum": 43, "regime": 11, "rx_micro": 49,
    }


def test_member_column_counts():
    ridge = ["legacy", "norm_core", "ofi_safe", "conditional_momentum_interaction", "rx_micro"]
    boosted = ["legacy", "norm_core", "ofi_safe", "trade_impact", "lag", "roll", "patch_summary", "cross_rank", "regime_tree", "rx_micro"]
    assert len(CATALOGUE.columns(ridge)) == 157
    assert len(CATALOGUE.columns(boosted)) == 462
    assert len(CATALOGUE.columns([*ridge, *boosted])) == 482


def test_group_rules():
    full = CATALOGUE.resolve(None)
    assert full == CATALOGUE.resolve("full") == CATALOGUE.resolve([])
    assert "mid_ret_lag_30" in CATALOGUE.stages["lag"].groups["lag_short"]
    assert "spread_rm30" in CATALOGUE.stages["roll"].groups["roll_short"]
    assert set(CATALOGUE.resolve(["norm_core"])) == {"base", "cross"}
    assert CATALOGUE.columns(["trade_impact"]) == CATALOGUE.columns(["trade_impact_safe"])
    with pytest.raises(KeyError):
        CATALOGUE.resolve(["nothing"])


def test_closures():
    assert CATALOGUE.downstream("ofi") == {"trade_impact", "cross", "conditional_momentum"}
    assert CATALOGUE.upstream(["cross"]) == ["base", "ofi", "trade_impact", "cross"]


def test_bad_graphs():
    build = lambda p, d: d
    with pytest.raises(ValueError):
        Catalogue([Stage("a", build, []), Stage("a", build, [])])
    with pytest.raises(ValueError):
        Catalogue([Stage("a", build, [], status="odd")])
    with pytest.raises(ValueError):
        Catalogue([Stage("a", build, [], ("b",)), Stage("b", build, [], ("a",))]).order()
    with pytest.raises(ValueError):
        Catalogue([Stage("a", build, [], ("gone",))]).order()
    with pytest.raises(ValueError):
        Catalogue([Stage("a", build, [], status="archived"), Stage("b", build, [], ("a",))]).order()
