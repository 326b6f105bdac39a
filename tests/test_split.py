"""Groups too large for a task: the splitting forms return what plain windows return."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspan.operators import blend, features as fx, labels, sequences
from barspan.plans import order_stats, series as series_module
from barspan.plans.catalogue import CATALOGUE
from barspan.plans.layout import Layout, Limits
from barspan.plans.series import Series, ema_halo, run_on_series, with_emas, with_gap_ema, with_rolling
from barspan.sources.bars import Panel, panel_from_events, read_panel

TIGHT = Limits(series_rows=20, cross_rows=3, date_rows=60, chunk_rows=16, page_members=3)
KEYS = ["date", "symbol", "bar"]


@pytest.fixture(scope="module")
def panels(spark, sf_dir):
    return panel_from_events(spark, sf_dir), panel_from_events(spark, sf_dir, TIGHT)


def close(plain, split, columns, tolerance=1e-9):
    a = plain.select(*KEYS, *columns).toPandas().sort_values(KEYS).reset_index(drop=True)
    b = split.select(*KEYS, *columns).toPandas().sort_values(KEYS).reset_index(drop=True)
    assert len(a) == len(b)
    for c in columns:
        x, y = a[c].to_numpy(float), b[c].to_numpy(float)
        assert np.allclose(x, y, rtol=tolerance, atol=tolerance, equal_nan=True), c


@pytest.mark.parametrize(
    "stage", ["base", "ofi", "lag", "roll", "patch", "cross", "conditional_momentum", "regime", "rx_micro"]
)
def test_stages(panels, stage):
    plain, split = panels
    assert split.split_series and not split.cross_fits and not split.date_fits
    names = CATALOGUE.stages[stage].columns
    if stage == "cross":
        names = [c for c in names if c.startswith(("obi0", "ofi_total", "interval", "spread"))]
        build = lambda p: fx.time_of_day(p, _few_ranks(p))
    else:
        build = lambda p: CATALOGUE.with_stages(p, [stage])
    close(build(plain), build(split), names, 1e-6)


def _few_ranks(panel):
    """Splitting ranks takes one pass per column, so a few columns stand for all."""
    few = ["spread", "obi0", "ofi_total"]
    df = fx.ofi_levels(panel, fx.base(panel, panel.df))
    df = fx.impact_static(df)
    df = fx.cross_z(panel, df)
    stored = {f"_f_{c}": F.col(c).cast("float").cast("double") for c in few}
    return order_stats.pct_ranks(
        df.withColumns(stored), panel.cross_fits, {f"{c}_cs_rank": f"_f_{c}" for c in few}, ["date", "bar"]
    )


def test_gap_average_in_chunks(spark, short_blocks):
    """Values so rare that a halo of rows would hold hardly any of them."""
    n = 9000
    df, pdf = long_series(spark, n)
    rare = pdf["pos"] % 9 == 4
    df = df.withColumn("x", F.when(F.col("pos") % 9 == 4, F.col("x")))
    pdf.loc[~rare, "x"] = np.nan
    panel = Panel(df, Layout(n, 1, n, n), Limits(series_rows=100, chunk_rows=450))
    out = fx.gap_average(panel, df, "x", "y", 5).orderBy("pos").toPandas()
    expected = pdf["x"].ewm(halflife=5, adjust=False).mean().to_numpy()
    assert np.allclose(out["y"].to_numpy(float), expected, rtol=1e-9, atol=1e-9, equal_nan=True)


def test_sequences(panels):
    plain, split = panels
    a = sequences.gather_windows(plain, plain.df, ["midpx", "bsize0"], 7)
    b = sequences.gather_windows(split, split.df, ["midpx", "bsize0"], 7)
    flat = lambda d: d.select(*KEYS, *[F.col("x")[t][i].alias(f"x{t}_{i}") for t in range(7) for i in range(2)])
    close(flat(a), flat(b), [f"x{t}_{i}" for t in range(7) for i in range(2)])


def test_snapshot_pages(panels):
    plain, split = panels

    def members(p):
        shots = sequences.snapshots(p, sequences.window_ends(p, 4), ["midpx"])
        return shots.select("date", "bar", "size", F.inline("members")).toPandas()

    a, b = members(plain), members(split)
    by = ["date", "bar", "slot"]
    assert a.sort_values(by).to_numpy().tolist() == b.sort_values(by)[a.columns].to_numpy().tolist()
    pages = sequences.padded_batches(split, sequences.window_ends(split, 4), ["midpx"], 5)
    assert pages.agg(F.max(F.size("mask"))).first()[0] <= 3
    whole = sequences.padded_batches(plain, sequences.window_ends(plain, 4), ["midpx"], 5)
    count = lambda d: d.select(F.explode("mask").alias("m")).where("m").count()
    assert count(pages) == count(whole)


@pytest.mark.parametrize("kind", ["large", "text"])
def test_symbols_of_any_type(spark, kind):
    """Symbols beyond 2^53 and text symbols get the same slots in both forms."""
    names = [2**53 + k for k in (5, 1, 0, 3, 2, 4)] if kind == "large" else ["b", "aa", "ab", "Z", "10", "9"]
    symbol = "bigint" if kind == "large" else "string"
    rows = [(20240101, s, 93000000 + b, float(b)) for s in names for b in range(3)]
    df = spark.createDataFrame(rows, f"date bigint, symbol {symbol}, bar bigint, x double")
    found = []
    for limits in (Limits(), TIGHT):
        out = sequences.member_slots(Panel(df, Layout(3, 6, 18, 18), limits), df)
        found.append(sorted(tuple(r) for r in out.select(*KEYS, "slot", "size", "x").collect()))
    assert found[0] == found[1] and len(found[0]) == 18
    assert [r[1] for r in sorted(found[0], key=lambda r: r[3]) if r[2] == 93000000] == sorted(names)


def test_padding_pages_are_whole(panels):
    """Batches of snapshots of unequal size: the split form has every padding cell of the plain one."""
    plain, split = panels
    cells = []
    for p in (plain, split):
        out = sequences.padded_batches(p, sequences.window_ends(p, 4), ["midpx"], 16)
        tall = out.select("batch", "date", "bar", "page", F.posexplode("mask").alias("i", "m"))
        slot = F.col("page") * F.lit(p.limits.page_members) + F.col("i")
        cells.append(sorted(tuple(r) for r in tall.select("batch", "date", "bar", slot, "m").collect()))
    assert cells[0] == cells[1] and not all(c[-1] for c in cells[0])


def test_repeated_keys_are_an_error(spark, panels, tmp_path):
    plain, _ = panels
    path = str(tmp_path / "twice")
    plain.df.unionByName(plain.df.limit(1)).write.partitionBy("date").parquet(path)
    with pytest.raises(ValueError, match="more than once"):
        read_panel(spark, path)


def test_read_panel_numbers_series(spark, panels, tmp_path):
    plain, _ = panels
    path = str(tmp_path / "bars")
    plain.df.write.partitionBy("date").parquet(path)
    read = read_panel(spark, path, limits=TIGHT)
    sizes = read.df.groupBy("date", "symbol").agg(F.max("pos").alias("p"), F.count(F.lit(1)).alias("n"))
    assert sizes.where("p != n").count() == 0
    assert read_panel(spark, path, dates=[20240101]).df.select("date").distinct().count() == 1
    with pytest.raises(ValueError):
        read_panel(spark, path, dates=[])


def long_series(spark, n, nulls=False):
    rng = np.random.default_rng(7)
    x = rng.normal(size=n) * 10.0 ** rng.integers(-3, 4, n)
    if nulls:
        x[rng.random(n) < 0.3] = np.nan
    pdf = pd.DataFrame({"date": 20240102, "symbol": 1, "bar": np.arange(n) + 93000000, "pos": np.arange(1, n + 1), "x": x})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return df, pdf


@pytest.fixture
def short_blocks(monkeypatch):
    """Blocks of 40 half-lives keep the remainder below 1e-12 and the test small."""
    monkeypatch.setattr(series_module, "BLOCK_HALF_LIVES", 40)
    monkeypatch.setattr(series_module, "SAFE_EXPONENT", 100)


class Shape:
    def __init__(self, n):
        self.series_rows = n


@pytest.mark.parametrize("chunked", [False, True])
@pytest.mark.parametrize("half_life", [3, 12])
def test_long_exponential_average(spark, short_blocks, chunked, half_life):
    n = 6000
    df, pdf = long_series(spark, n)
    limits = Limits(series_rows=1000 if chunked else n, chunk_rows=1500)
    halo = series_module.ema_halo(half_life)
    out = run_on_series(
        df, Shape(n), limits, lambda d, s: with_emas(d, s, {"y": ("x", half_life)}), halo
    ).orderBy("pos").toPandas()
    expected = pdf["x"].ewm(halflife=half_life, adjust=False).mean().to_numpy()
    assert len(out) == n
    assert np.allclose(out["y"].to_numpy(), expected, rtol=1e-9, atol=1e-8)


def test_gap_average_equals_pandas(spark):
    df, pdf = long_series(spark, 1500, nulls=True)
    out = with_gap_ema(df, Series(longest=1500), "y", "x", 5).orderBy("pos").toPandas()
    expected = pdf["x"].ewm(halflife=5, adjust=False).mean().to_numpy()
    assert np.allclose(out["y"].to_numpy(float), expected, rtol=1e-9, atol=1e-9, equal_nan=True)


def test_forward_fill_across_chunks(spark):
    df, pdf = long_series(spark, 400, nulls=True)
    df = df.withColumn("x", F.when((F.col("pos") < 20) | (F.col("pos").between(90, 230)), None).otherwise(F.col("x")))
    pdf.loc[(pdf["pos"] < 20) | pdf["pos"].between(90, 230), "x"] = np.nan
    for limits in (Limits(), Limits(series_rows=10, chunk_rows=25)):
        out = series_module.forward_filled(df, Shape(400), limits, "x", "y").orderBy("pos").toPandas()
        assert np.allclose(out["y"].to_numpy(float), pdf["x"].ffill().to_numpy(), equal_nan=True)


def test_nested_rolling_equals_direct(spark):
    df, pdf = long_series(spark, 300)
    windows = [3, 5, 10, 20, 30, 60]
    df = with_rolling(df, Series(longest=300), ["x"], windows)
    out = df.orderBy("pos").toPandas()
    x = pdf["x"].to_numpy()
    for w in windows:
        frames = [x[max(0, i - w + 1) : i + 1] for i in range(300)]
        direct = lambda f: np.array([f(v) for v in frames])  # noqa: B023
        assert np.allclose(out[f"_sum{w}_x"], direct(np.sum), rtol=1e-9, atol=1e-9)
        assert np.allclose(out[f"_squares{w}_x"], direct(lambda v: v.var() * len(v)), rtol=1e-9, atol=1e-12)
        assert np.allclose(out[f"_max{w}_x"], direct(np.max)) and np.allclose(out[f"_min{w}_x"], direct(np.min))


def test_halo_covers_long_memory():
    assert ema_halo(24) == 2 * series_module.BLOCK_HALF_LIVES * 24


# -- order statistics --------------------------------------------------------------


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(0)
    n = 4000
    x = np.round(rng.standard_cauchy(n) * 10.0 ** rng.integers(-9, 9, n), 2)
    x[::3] = 0.5  # a third of all rows share one value
    x[1::40], x[2::70], x[5::80] = np.nextafter(0.5, 0), -0.0, 2.0**-60
    group = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 5, n))
    pdf = pd.DataFrame({"id": np.arange(n), "g": group, "x": x})
    pdf.loc[7::50, "x"] = np.nan
    return spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))), pdf


@pytest.mark.parametrize("groups", [["g"], []])
def test_rank_equals_pandas(values, groups):
    df, pdf = values
    ranks = pdf.groupby("g")["x"].rank(pct=True) if groups else pdf["x"].rank(pct=True)
    for fits in (True, False):
        out = order_stats.pct_ranks(df, fits, {"r": "x"}, groups).orderBy("id").toPandas()
        assert np.allclose(out["r"].to_numpy(float), ranks, rtol=1e-12, equal_nan=True)


def test_quantiles_equal_pandas(values):
    df, pdf = values
    wanted = {"a": 0.33, "b": 0.5, "c": 0.99, "d": 0.0, "e": 1.0}
    for fits in (True, False):
        out = order_stats.quantiles(df, ["g"], "x", wanted, fits).orderBy("g").toPandas()
        for name, q in wanted.items():
            assert np.allclose(out[name], pdf.groupby("g")["x"].quantile(q), rtol=1e-12)


def test_smallest_rows_is_exact(values):
    df, pdf = values
    for k in (1, 500, 2500):
        out = order_stats.smallest_rows(df.where("x is not null"), "x", F.lit(k), ["id"]).toPandas()
        assert len(out) == k
        assert out["x"].max() == np.sort(pdf["x"].dropna())[k - 1]


def test_sampling_is_exact_and_keeps_every_day(panels):
    plain, _ = panels
    rows = plain.df.select(*KEYS, "fret12")
    assert labels.sample_rows(rows, 0.33, model="ridge") is rows
    assert labels.sample_rows(rows, None) is rows
    sampled = labels.sample_rows(rows, 0.33, model="lgbm")
    assert sampled.count() == int(10000 * 0.33)
    assert sampled.select("date").distinct().count() == 30
    again = labels.sample_rows(rows.repartition(3), 0.33, model="lgbm")
    assert sampled.exceptAll(again).count() == 0


def test_clip_and_grid_agree_with_direct_scores(panels):
    plain, split = panels
    rows = plain.df.select(*KEYS, F.col("fret12").alias("label"), (F.col("midpx") / F.col("open") - 1).alias("pred"))
    a = blend.postprocess_grid(plain, rows).orderBy("at").toPandas()
    b = blend.postprocess_grid(split, rows).orderBy("at").toPandas()
    assert a["name"].tolist() == b["name"].tolist() and len(a) == 21
    for c in ("corr", "mse", "r2"):
        assert np.allclose(a[c], b[c], rtol=1e-9)
    best = blend.best_candidate(blend.postprocess_grid(plain, rows)).first()
    assert best["corr"] == a["corr"].max()


def test_tasks_of_window_chains_hold_a_bounded_number_of_rows(spark, sf_dir):
    """Adaptive execution packs small shuffled groups together; chains of sorts get tasks sized by rows instead."""
    from pyspark.sql import functions as F

    small, whole = (panel_from_events(spark, sf_dir, limits) for limits in (Limits(task_rows=400), Limits()))
    assert whole.df.count() > 20 * 400
    largest = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest(small.df) < 6 * 400
    ranks = [fx.cross_rank(p, fx.cross_z(p, CATALOGUE.with_stages(p, {n: [] for n in ("base", "ofi", "trade_impact")}))) for p in (small, whole)]
    assert largest(ranks[0]) < 3 * 400
    columns = ["date", "symbol", "bar", "midpx_cs_z", "ofi_total_cs_rank"]
    same = [r.select(*columns).orderBy("date", "symbol", "bar").toPandas() for r in ranks]
    pd.testing.assert_frame_equal(*same)


@pytest.mark.parametrize("name, most", [("d18_cross_zscores", 45), ("d25_regime_buckets", 45), ("d27_date_volatility", 10)])
def test_split_queries_write_only_columns_they_use(spark, sf_dir, monkeypatch, name, most):
    from barspan.plans import groups
    from barspan.queries.feature_queries import QUERIES

    panel, widths = panel_from_events(spark, sf_dir, TIGHT), []

    def seen(df, label):
        widths.append(len(df.columns))
        return df

    for module in (groups, series_module, fx):
        monkeypatch.setattr(module, "written", seen)
    QUERIES[name].over(panel)
    assert widths and max(widths) <= most, widths
