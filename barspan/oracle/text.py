"""Pieces of the comparison SQL: named CTEs and the wrapper that strings the
needed ones together. The SQL is written against DuckDB and states every result
a second time, independently of the DataFrame code."""

from __future__ import annotations

from collections.abc import Iterable

from barspan.functions.scalars import shown_scale

KEYS = ["date", "symbol", "bar"]
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: Iterable[str] | str, body: str) -> None:
    needs = (needs,) if isinstance(needs, str) else tuple(needs)
    CTES[name] = (needs, body)


def query(final: str, *needs: str) -> str:
    chosen: list[str] = []

    def visit(name: str) -> None:
        if name in chosen:
            return
        for need in CTES[name][0]:
            visit(need)
        chosen.append(name)

    for name in needs:
        visit(name)
    listed = ",\n".join(f"{name} AS (\n{CTES[name][1]}\n)" for name in chosen)
    return f"WITH {listed}\n{final}" if chosen else final


def q(x: str, name: str | None = None) -> str:
    """Six decimals of the scaled value at float precision, as in ``presented``."""
    name = name or x
    if shown_scale(name) != 1.0:
        x = f"({x} * {shown_scale(name)!r})"
    return (
        f"CAST(CAST(CASE WHEN abs({x}) < 1e12 THEN floor({x} * 1e6 + 0.5) / 1e6 ELSE {x} END AS FLOAT) "
        f"AS DOUBLE) AS {name}"
    )


def show(source: str, numbers: Iterable[str], keys: Iterable[str] = KEYS, extra: str = "") -> str:
    columns = ", ".join([*keys, *[q(c) for c in numbers]])
    return query(f"SELECT {columns} FROM {source} {extra}", source)


def fin(x: str) -> str:
    return f"(CASE WHEN abs({x}) < 'Infinity'::DOUBLE THEN {x} END)"


def cl(x: str) -> str:
    """Null, NaN and infinity become 0."""
    return f"coalesce(CASE WHEN abs({x}) < 'Infinity'::DOUBLE THEN {x} END, 0.0)"


def da(a: str, b: str) -> str:
    return f"(({a}) / (abs({b}) + 1e-8))"


def de(a: str, b: str) -> str:
    return f"(({a}) / (({b}) + 1e-9))"


def imb(a: str, b: str) -> str:
    return da(f"{a} - {b}", f"{a} + {b}")


def imbe(a: str, b: str) -> str:
    return de(f"{a} - {b}", f"{a} + {b}")


def snap(x: str, digits: int = 12) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


def fl(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def f32(x: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


P = "PARTITION BY date, symbol ORDER BY bar"


def last(w: int) -> str:
    return f"({P} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


SO_FAR = f"({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({P})"


def mean(x: str, w: int) -> str:
    return f"avg({x}) OVER {last(w)}"


def std(x: str, w: int) -> str:
    return f"stddev_pop({x}) OVER {last(w)}"


def zscore(x: str, w: int, eps: str, min_rows: int = 1) -> str:
    o = last(w)
    z = (
        f"CASE WHEN max({x}) OVER {o} = min({x}) OVER {o} THEN 0.0 "
        f"ELSE ({x} - avg({x}) OVER {o}) / (stddev_pop({x}) OVER {o} + {eps}) END"
    )
    return z if min_rows == 1 else f"CASE WHEN count({x}) OVER {o} >= {min_rows} THEN {z} END"


def ema(x: str, h: int) -> str:
    """Needs a column k, the 0-based position in the series."""
    a = f"(1 - pow(2.0, -1.0 / {h}))"
    weight = f"(CASE WHEN k = 0 THEN 1.0 ELSE {a} END)"
    return f"(sum({x} * {weight} * pow(2.0, k / {h}.0)) OVER {SO_FAR} * pow(2.0, -k / {h}.0))"


def change(n: int) -> str:
    return cl(f"(midpx / lag(midpx, {n}) OVER ({P}) - 1)")


def rank(x: str, groups: str) -> str:
    return (
        f"((rank() OVER (PARTITION BY {groups} ORDER BY {x}) + "
        f"(count(*) OVER (PARTITION BY {groups}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {groups}))"
    )


def columns(pairs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in pairs.items())


def corr(x: str, y: str) -> str:
    return (
        f"(CASE WHEN max({x}) > min({x}) AND max({y}) > min({y}) "
        f"THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END)"
    )
