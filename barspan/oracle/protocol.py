"""Scans, calendar, folds, labels, sequences, metrics and blends as SQL."""

from __future__ import annotations

from barspan.oracle.features import CROSS, PRICES, SQL as _FEATURES, TRATIOS, VOLUMES  # noqa: F401
from barspan.oracle.text import P, cl, columns, corr, cte, da, de, f32, fl, query, q, rank, show

SQL: dict[str, str] = {}
RAW = ["midpx", *PRICES, *VOLUMES, *TRATIOS]
K = "date, symbol, bar"


def qs(*names: str) -> str:
    return ", ".join(q(n) for n in names)


# calendars
cte("days", "bars", "SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos FROM (SELECT DISTINCT date AS day FROM bars)")
cte("wdays", "bars", """SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos FROM (SELECT DISTINCT date AS day FROM bars
  WHERE dayofweek(strptime(CAST(date AS VARCHAR), '%Y%m%d')) BETWEEN 1 AND 5)""")
cte("dates", "bars", "SELECT DISTINCT date FROM bars")

SQL["a01_scan_days"] = show("bars", [*RAW, "fret12"])
SQL["a02_count_per_day"] = query("SELECT date, count(*) AS n_rows FROM bars GROUP BY date", "bars")
SQL["a03_available_days"] = query("SELECT DISTINCT date AS day FROM bars", "bars")
SQL["a04_first_symbols"] = query(
    f"SELECT {K}, {qs('midpx', 'fret12')} FROM bars WHERE symbol IN (SELECT DISTINCT symbol FROM bars ORDER BY symbol LIMIT 5)",
    "bars")
SQL["a05_keys_and_label"] = show("bars", ["fret12"])

# predictions
cte("pa", "bars", f"SELECT {K}, fret12 AS label, midpx / open - 1 AS pred FROM bars")
cte("pb", "bars", f"""SELECT {K}, label, pred FROM (SELECT *, fret12 AS label,
  (bsize0 - asize0) / (bsize0 + asize0) / 1000 AS pred, row_number() OVER ({P}) AS rn FROM bars) WHERE rn >= 8""")
cte("pab", "bars", f"""SELECT {K}, fret12 AS label, midpx / open - 1 AS pred_a,
  (bsize0 - asize0) / (bsize0 + asize0) / 1000 AS pred_b FROM bars""")
cte("tall", "pab", f"""SELECT 'R02_ridge_legacy_plus_norm_core' AS experiment_id, {K}, label, pred_a AS pred FROM pab
UNION ALL SELECT 'X1_book', {K}, label, pred_b FROM pab
UNION ALL SELECT 'X2_mean', {K}, label, (pred_a + pred_b) / 2 FROM pab""")
cte("joined", ("pa", "pb"), f"SELECT {K}, pa.label, pa.pred AS pred_a, pb.pred AS pred_b FROM pa JOIN pb USING ({K})")
SQL["a15_average_duplicates"] = query(f"""SELECT {K}, {qs('pred', 'label')} FROM (
  SELECT {K}, avg(pred) AS pred, max(label) AS label FROM (SELECT * FROM pa UNION ALL SELECT * FROM pb) GROUP BY {K})""",
  "pa", "pb")

# calendar lookups
SQL["b01_trading_days"] = query("SELECT date FROM dates WHERE date IN (SELECT day FROM wdays)", "dates", "wdays")
SQL["b02_same_or_next_day"] = query(
    "SELECT date, (SELECT min(day) FROM wdays WHERE day >= date) AS trading_day FROM dates", "dates", "wdays")
SQL["b03_next_and_previous_day"] = query("""SELECT date, (SELECT min(day) FROM wdays WHERE day > date) AS next_day,
  (SELECT max(day) FROM wdays WHERE day < date) AS prev_day FROM dates""", "dates", "wdays")
SQL["b04_shifted_day"] = query("""SELECT date, CASE WHEN n_before > 0 THEN
  (SELECT day FROM wdays WHERE pos = n_before + 3) END AS shifted
  FROM (SELECT date, (SELECT count(*) FROM wdays WHERE day < date) AS n_before FROM dates)""", "dates", "wdays")
SQL["b05_days_around"] = query("""SELECT date,
  (SELECT string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) FROM wdays WHERE pos >= n_before - 4 AND pos < n_before) AS days_before,
  (SELECT string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) FROM wdays WHERE pos >= n_through AND pos < n_through + 4) AS days_after
  FROM (SELECT date, (SELECT count(*) FROM wdays WHERE day < date) AS n_before,
    (SELECT count(*) FROM wdays WHERE day <= date) AS n_through FROM dates)""", "dates", "wdays")
SQL["b06_day_range"] = query("SELECT * FROM wdays WHERE day BETWEEN 20240106 AND 20240121", "wdays")
SQL["b07_automatic_split"] = query("""SELECT (SELECT min(day) FROM days) AS train_start,
  (SELECT day FROM days WHERE pos = n - held - 1) AS train_end, (SELECT day FROM days WHERE pos = n - held) AS eval_start,
  (SELECT max(day) FROM days) AS eval_end
  FROM (SELECT count(*) AS n, CASE WHEN count(*) > 20 THEN 20 ELSE 1 END AS held FROM days)""", "days")

# scalars
SQL["c01_division_abs"] = query(
    f"SELECT {K}, {q('r', 'ratio')} FROM (SELECT {K}, {da('tradeBuyTurnover', '(tradeBuyQty - tradeSellQty)')} AS r FROM bars)", "bars")
SQL["c02_division_signed"] = query(
    f"SELECT {K}, {q('r', 'ratio')} FROM (SELECT {K}, {de('tradeBuyTurnover', 'tradeBuyQty - tradeSellQty')} AS r FROM bars)", "bars")
SQL["c03_cleaned_channels"] = query(
    f"SELECT {K}, {qs(*RAW)} FROM (SELECT {K}, {columns({c: cl(c) for c in RAW})} FROM bars)", "bars")
SQL["c04_scalar_functions"] = query(f"""SELECT {K}, {qs('sign_gap', 'abs_gap', 'clipped', 'log1p_qty', 'log_floor', 'is_up')}
  FROM (SELECT {K}, CAST(sign(lastpx - midpx) AS DOUBLE) AS sign_gap, abs(lastpx - midpx) AS abs_gap,
  greatest(least(lastpx - midpx, 0.01), -0.01) AS clipped, ln(1 + tradeBuyQty) AS log1p_qty,
  ln(greatest(lastpx, 1e-9)) AS log_floor, {fl('lastpx - midpx > 0')} AS is_up FROM bars)""", "bars")
SQL["c05_date_and_symbol_sets"] = query(f"""SELECT {K}, {qs('midpx')} FROM bars WHERE date IN (SELECT day FROM wdays)
  AND symbol IN (1, 3, 5, 7, 9)""", "bars", "wdays")
GROUP = ["ob_imb0", "ob_imb4", "ob_imb9", "trade_imb", "trade_imbema5", "lagret12", "spread", "mid_ret1_raw", "obi0",
         "obi4", "obi9", "trade_turnover_imb", "add_imb", "cxl_imb", "qty_add_imb", "qty_cxl_imb", "buy_vwad_gap",
         "sell_vwad_gap", "trade_activity", "order_pressure", *[f"{c}_cs_z" for c in CROSS], "fret12"]
SQL["e05_features_for_groups"] = show("group_set", GROUP)


# folds: cursors, then segment bounds by calendar position
def sliding(name: str, train: int, val: int, step: int, embargo: int = 1) -> str:
    return f"""SELECT '{name}' AS profile, CAST((c - {train + embargo}) / {step} AS BIGINT) AS fold_id,
  c - {embargo + train} AS t0, c - {embargo} AS t1, c AS v0, c + {val} AS v1
  FROM (SELECT unnest(generate_series({train + embargo}, (SELECT CAST(count(*) AS BIGINT) FROM days) - {val}, {step})) AS c)"""


def expanding(name: str, train: int, val: int, step: int, embargo: int = 1) -> str:
    return f"""SELECT '{name}' AS profile, CAST((c - {train}) / {step} AS BIGINT) AS fold_id,
  0 AS t0, c AS t1, c + {embargo} AS v0, c + {embargo} + {val} AS v1
  FROM (SELECT unnest(generate_series({train}, (SELECT CAST(count(*) AS BIGINT) FROM days) - {embargo + val}, {step})) AS c)"""


cte("cuts", "days", "\nUNION ALL ".join([
    sliding("short_8d_2d", 8, 2, 5), sliding("medium_20d_5d", 20, 5, 5), sliding("long_12d_3d", 12, 3, 6),
    expanding("expanding_12d_3d", 12, 3, 3)]))
cte("fold_table", ("cuts", "days"), """SELECT profile, fold_id,
  (SELECT day FROM days WHERE pos = t0) AS train_start, (SELECT day FROM days WHERE pos = t1 - 1) AS train_end,
  (SELECT day FROM days WHERE pos = t1) AS embargo_start, (SELECT day FROM days WHERE pos = v0 - 1) AS embargo_end,
  (SELECT day FROM days WHERE pos = v0) AS val_start, (SELECT day FROM days WHERE pos = v1 - 1) AS val_end,
  CAST(t1 - t0 AS BIGINT) AS n_train_days, CAST(v1 - v0 AS BIGINT) AS n_val_days FROM cuts""")
cte("fold_days", ("cuts", "days"), """SELECT profile, fold_id, day AS date,
  CASE WHEN pos < t1 THEN 'train' ELSE 'val' END AS segment
  FROM cuts JOIN days ON (pos >= t0 AND pos < t1) OR (pos >= v0 AND pos < v1)""")
SQL["f01_sliding_folds"] = query("SELECT * FROM fold_table WHERE profile IN ('short_8d_2d', 'medium_20d_5d')", "fold_table")
SQL["f02_expanding_folds"] = query("SELECT * FROM fold_table WHERE profile = 'expanding_12d_3d'", "fold_table")
SQL["f03_simple_folds"] = query(f"""SELECT fold_id, (SELECT day FROM days WHERE pos = t0) AS train_start,
  (SELECT day FROM days WHERE pos = t1 - 1) AS train_end, (SELECT day FROM days WHERE pos = v0) AS val_start,
  (SELECT day FROM days WHERE pos = v1 - 1) AS val_end, CAST(t1 - t0 AS BIGINT) AS n_train_days,
  CAST(v1 - v0 AS BIGINT) AS n_val_days, kind FROM (
  SELECT fold_id, t0, t1, v0, v1, 'regular' AS kind FROM ({sliding('x', 10, 4, 4, 0)})
  UNION ALL SELECT 0, 0, n - h, n - h, n, 'fallback' FROM (
    SELECT count(*) AS n, greatest(1, least(2, CAST(floor(count(*) / 3.0) AS BIGINT))) AS h FROM days)
    WHERE n < 50 AND n >= 3)""", "days")
SQL["f05_recent_folds"] = query("""SELECT CAST(count(*) OVER () - 1 - k AS BIGINT) AS fold_id,
  (SELECT day FROM days WHERE pos = hi - 3 - 1 - 1) AS train_end, (SELECT day FROM days WHERE pos = hi - 3) AS val_start,
  (SELECT day FROM days WHERE pos = hi - 1) AS val_end FROM (
  SELECT k, (SELECT count(*) FROM days) - 3 * k AS hi FROM (SELECT unnest(generate_series(0, 3)) AS k)) WHERE hi - 4 >= 10""", "days")
TAIL = "greatest(least(greatest(1, CAST(round_even({n} * 0.15, 0) AS BIGINT)), greatest(0, {n} - 10)), 0)"
SQL["f06_early_stop_lengths"] = query(
    f"SELECT n, CAST({TAIL.format(n='n')} AS BIGINT) AS tail FROM (SELECT pos + 1 AS n FROM days)", "days")


def segments(cuts: str, embargo: int) -> str:
    tail = TAIL.format(n="(t1 - t0)")
    return f"""SELECT fold_id, day, CASE WHEN pos < t1 - {tail} THEN 'train_core' WHEN pos < t1 THEN 'earlystop'
  WHEN pos < t1 + {embargo} THEN 'embargo' ELSE 'scoring' END AS segment
  FROM ({cuts}) JOIN days ON (pos >= t0 AND pos < t1 + {embargo}) OR (pos >= v0 AND pos < v1)"""


EXPANDING = "SELECT * FROM cuts WHERE profile = 'expanding_12d_3d'"
RECENT = """SELECT CAST(count(*) OVER () - 1 - k AS BIGINT) AS fold_id, 0 AS t0, hi - 4 AS t1, hi - 3 AS v0, hi AS v1 FROM (
  SELECT k, (SELECT count(*) FROM days) - 3 * k AS hi FROM (SELECT unnest(generate_series(0, 2)) AS k)) WHERE hi - 4 >= 12"""
SQL["f07_four_segment_folds"] = query(
    f"SELECT *, 'first' AS pick FROM ({segments(EXPANDING, 1)}) UNION ALL SELECT *, 'recent' FROM ({segments(RECENT, 1)})",
    "cuts", "days")
DELIVERY = """SELECT CAST(0 AS BIGINT) AS fold_id, 0 AS t0, c AS t1, c + 2 AS v0, n AS v1 FROM (
  SELECT (SELECT count(*) FROM days WHERE day <= 20240122) AS c, (SELECT count(*) FROM days WHERE day <= 20240130) AS n)"""
SQL["f08_delivery_fold"] = query(segments(DELIVERY, 2), "days")
SQL["f09_causality_violations"] = query(f"""SELECT * FROM (WITH s AS ({segments(EXPANDING, 1)}),
  o AS (SELECT *, CASE segment WHEN 'train_core' THEN 0 WHEN 'earlystop' THEN 1 WHEN 'embargo' THEN 2 ELSE 3 END AS ord FROM s),
  g AS (SELECT fold_id, ord, min(day) AS lo, max(day) AS hi FROM o GROUP BY fold_id, ord)
  SELECT s.fold_id, count(*) AS n_days, CAST((SELECT count(*) FROM g a JOIN g b ON a.fold_id = b.fold_id AND a.ord < b.ord
    WHERE a.hi >= b.lo AND a.fold_id = s.fold_id) AS BIGINT) AS n_bad FROM s GROUP BY s.fold_id)""", "cuts", "days")
SQL["f10_holdout"] = query(f"""SELECT {K}, 'review' AS holdout_name, CASE WHEN date <= 20240120 THEN 'train' ELSE 'holdout' END
  AS segment, {qs('midpx')} FROM bars WHERE date BETWEEN 20240101 AND 20240120 OR date BETWEEN 20240122 AND 20240130""", "bars")
SQL["f11_folds_on_bars"] = query(f"""SELECT profile, fold_id, segment, n_rows, {qs('label_mean')} FROM (
  SELECT profile, fold_id, segment, count(*) AS n_rows, avg(fret12) AS label_mean FROM bars JOIN fold_days USING (date)
  GROUP BY profile, fold_id, segment)""", "bars", "fold_days")

# labels
SQL["g01_target_modes"] = query(f"""SELECT {K}, {qs('y_raw', 'y_date_demean', 'y_interval_demean', 'y_interval_residual')} FROM (
  SELECT {K}, fret12 AS y_raw, fret12 - avg(fret12) OVER (PARTITION BY date) AS y_date_demean,
  fret12 - avg(fret12) OVER (PARTITION BY date, bar) AS y_interval_demean,
  fret12 - avg(fret12) OVER (PARTITION BY bar) AS y_interval_residual FROM bars)""", "bars")
SQL["g02_interval_baseline"] = query(f"""SELECT {K}, {qs('pred')} FROM (
  SELECT pa.date, symbol, pa.bar, pred + coalesce(m, 0.0) AS pred FROM pa LEFT JOIN (
    SELECT bar, avg(fret12) AS m FROM bars WHERE date <= 20240120 GROUP BY bar) b ON pa.bar = b.bar
  WHERE pa.date > 20240120)""", "pa", "bars")
SQL["g03_winsorized_labels"] = query(f"""SELECT fold_id, {K}, {qs('target')} FROM (
  SELECT fold_id, {K}, greatest(least(fret12, hi), lo) AS target FROM bars
  JOIN (SELECT * FROM fold_days WHERE profile = 'short_8d_2d' AND segment = 'train') USING (date)
  JOIN (SELECT fold_id, quantile_cont(fret12, 0.01) AS lo, quantile_cont(fret12, 0.99) AS hi FROM bars
    JOIN (SELECT * FROM fold_days WHERE profile = 'short_8d_2d' AND segment = 'train') USING (date) GROUP BY fold_id)
  USING (fold_id))""", "bars", "fold_days")
SQL["g04_common_targets"] = query(f"""SELECT date, bar, {qs('fret12_common')} FROM (
  SELECT date, bar, avg(fret12) AS fret12_common FROM bars GROUP BY date, bar)""", "bars")
COMMON = ["spread", "obi0", "obi4", "trade_imb", "trade_turnover_imb", "cxl_imb", "trade_activity", "order_pressure",
          "mid_ret1_raw", "regime_score", "state_vol_cs", "state_spread_cs", "state_activity_cs"]
SQL["g05_common_features"] = query(f"""SELECT date, bar, {qs(*COMMON)} FROM (
  SELECT date, bar, {columns({c: f'avg({c})' for c in COMMON})} FROM reg GROUP BY date, bar)""", "reg")
SQL["g06_sampled_rows"] = query(f"""SELECT {K}, {qs('fret12')} FROM (SELECT *, row_number() OVER (ORDER BY draw, {K}) AS rn,
  count(*) OVER () AS n FROM (SELECT *, CAST('0x' || substr(md5(date || '-' || symbol || '-' || bar || '-42'), 1, 13) AS BIGINT)
  AS draw FROM bars)) WHERE rn <= floor(n * 0.33)""", "bars")
SQL["g07_regime_state"] = query(f"""SELECT {K}, CAST(CASE WHEN regime_low >= regime_mid AND regime_low >= regime_high THEN 0
  WHEN regime_mid >= regime_high THEN 1 ELSE 2 END AS BIGINT) AS state FROM reg""", "reg")

# sequences
SEQ = ["midpx", "bsize0", "buyVwad"]
cte("ends", "bars", f"SELECT * FROM (SELECT *, row_number() OVER ({P}) AS rn FROM bars) WHERE rn >= 6")
SQL["i01_window_ends"] = query(f"SELECT {K} FROM ends", "ends")
CELLS = {f"x{t}_{c}": f"coalesce(lag({c}, {5 - t}) OVER ({P}), 0.0)" for t in range(6) for c in SEQ}
SQL["i02_windows"] = query(f"""SELECT {K}, {qs(*CELLS, 'label')} FROM (SELECT {K}, fret12 AS label, {columns(CELLS)},
  row_number() OVER ({P}) AS rn FROM bars) WHERE rn >= 6""", "bars")
SQL["i03_window_labels"] = query(f"SELECT {K}, {qs('label')} FROM (SELECT *, fret12 AS label FROM ends)", "ends")
SQL["i04_normalized_channels"] = query(f"""SELECT {K}, {qs(*SEQ)} FROM (SELECT {K}, """ + ", ".join(
    f"(coalesce({c}, 0.0) - m_{c}) / (CASE WHEN s_{c} < 1e-8 THEN 1.0 ELSE s_{c} END) AS {c}" for c in SEQ) + """ FROM bars, (SELECT """
    + ", ".join(f"avg(coalesce({c}, 0.0)) AS m_{c}, stddev_pop(coalesce({c}, 0.0)) AS s_{c}" for c in SEQ)
    + " FROM bars WHERE date <= 20240120))", "bars")
SQL["i05_snapshots"] = query(f"""SELECT date, bar, CAST(0 AS BIGINT) AS page, size, symbols, {qs('mid_sum')} FROM (
  SELECT date, bar, count(*) AS size, string_agg(CAST(symbol AS VARCHAR), ',' ORDER BY symbol) AS symbols,
  sum(midpx) AS mid_sum FROM ends GROUP BY date, bar)""", "ends")
cte("slots", "ends", """SELECT date, symbol, bar, midpx, dense_rank() OVER (ORDER BY date, bar) - 1 AS snapshot,
  row_number() OVER (PARTITION BY date, bar ORDER BY symbol) - 1 AS slot, count(*) OVER (PARTITION BY date, bar) AS size FROM ends""")
SQL["i06_snapshot_order"] = query(f"SELECT {K}, snapshot, slot, size FROM slots", "slots")
SQL["i07_padded_batches"] = query(f"""SELECT batch, date, bar, slot, symbol, present, {qs('midpx')} FROM (
  WITH b AS (SELECT *, CAST(floor(snapshot / 16.0) AS BIGINT) AS batch FROM slots),
  w AS (SELECT batch, max(size) AS width FROM b GROUP BY batch),
  g AS (SELECT DISTINCT b.batch, date, bar, width FROM b JOIN w USING (batch)),
  c AS (SELECT batch, date, bar, unnest(generate_series(0, width - 1)) AS slot FROM g)
  SELECT c.batch, c.date, c.bar, CAST(c.slot AS BIGINT) AS slot, b.symbol, CAST(CASE WHEN b.symbol IS NULL THEN 0 ELSE 1 END AS BIGINT) AS present,
  coalesce(b.midpx, 0.0) AS midpx FROM c LEFT JOIN b ON c.date = b.date AND c.bar = b.bar AND c.slot = b.slot)""", "slots")
X = "PARTITION BY date, bar"
SQL["i08_snapshot_zscores"] = query(f"""SELECT {K}, {qs('bsize0_sz', 'tradeBuyQty_sz')} FROM (SELECT {K}, """ + ", ".join(
    f"({c} - avg({c}) OVER ({X})) / sqrt(greatest(var_pop({c}) OVER ({X}), 1e-5)) AS {c}_sz" for c in ("bsize0", "tradeBuyQty"))
    + " FROM bars)", "bars")
SQL["i09_flat_vectors"] = query(f"SELECT {K}, " + ", ".join(q(f"coalesce({c}, 0.0)", f"x_{c}") for c in SEQ)
                                + f", {q('fret12', 'label')} FROM bars", "bars")
SQL["i10_only_dates"] = query(f"SELECT {K}, {qs('fret12')} FROM bars WHERE date IN (SELECT day FROM wdays)", "bars", "wdays")

# metrics
SSE = "sum((pred - label) * (pred - label))"
POOLED = {"mse": "avg((pred - label) * (pred - label))", "corr": f"coalesce({corr('pred', 'label')}, 0.0)",
          "r2": f"1 - {SSE} / (var_pop(label) * count(*) + 1e-8)"}
SUBMIT = {"pearson": corr("pred", "label"), "r2": f"1 - {SSE} / nullif(var_samp(label), 0) / count(*)", "mse": f"{SSE} / count(*)"}


def scored(pairs: dict[str, str], source: str, by: str, final: str = "") -> str:
    return query(f"SELECT {by}, {qs(*pairs)} FROM (SELECT {by}, {columns(pairs)} FROM {source} GROUP BY {by}) {final}", source)


SQL["j01_pooled_scores"] = scored(POOLED, "tall", "experiment_id")
SQL["j02_submission_scores"] = scored(SUBMIT, "tall", "experiment_id")
DAILY = {"daily_corr_mean": "coalesce(avg(ic), 0.0)", "daily_corr_std": "coalesce(stddev_pop(ic), 0.0)",
         "daily_corr_min": "coalesce(min(ic), 0.0)"}
SQL["j03_daily_ic"] = query(f"""SELECT experiment_id, n_days, n_scored_days, {qs(*DAILY)} FROM (
  SELECT experiment_id, count(*) AS n_days, count(ic) AS n_scored_days, {columns(DAILY)} FROM (
    SELECT experiment_id, date, {corr('pred', 'label')} AS ic FROM tall GROUP BY experiment_id, date) GROUP BY experiment_id)""", "tall")


def safe(x: str, y: str) -> str:
    return (f"coalesce(CASE WHEN stddev_pop({x}) > 1e-12 AND stddev_pop({y}) > 1e-12 THEN "
            f"covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END, 0.0)")


LENS = ["pooled_corr", "fold_corr_mean", "fold_corr_std", "fold_corr_min", "fold_positive_rate", "stability_score",
        "daily_ic_mean", "daily_ic_std", "daily_ic_ir"]
cte("short_val", ("pab", "fold_days"),
    "SELECT pab.*, fold_id FROM pab JOIN fold_days USING (date) WHERE profile = 'short_8d_2d' AND segment = 'val'")
SQL["j04_lenses"] = query(f"""SELECT n_folds, n_rows, {qs(*LENS)} FROM (
  SELECT n_folds, n_rows, pooled_corr, fold_corr_mean, fold_corr_std, fold_corr_min, fold_positive_rate,
  fold_corr_mean - 0.7 * fold_corr_std AS stability_score, daily_ic_mean, daily_ic_std,
  CASE WHEN daily_ic_std > 1e-12 THEN daily_ic_mean / daily_ic_std END AS daily_ic_ir
  FROM (SELECT count(*) AS n_rows, {safe('pred_a', 'label')} AS pooled_corr FROM short_val),
  (SELECT count(*) AS n_folds, avg(c) AS fold_corr_mean, stddev_pop(c) AS fold_corr_std, min(c) AS fold_corr_min,
    avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END) AS fold_positive_rate FROM (SELECT {safe('pred_a', 'label')} AS c FROM short_val GROUP BY fold_id)),
  (SELECT avg(c) AS daily_ic_mean, stddev_pop(c) AS daily_ic_std FROM (SELECT {safe('pred_a', 'label')} AS c FROM short_val GROUP BY date)))""", "short_val")
SNAP = """SELECT avg(ic) AS snapshot_ic, count(*) AS n_snapshots FROM (SELECT date, bar, count(*) AS n,
  covar_pop(pred, label) * count(*) / sqrt(var_pop(pred) * count(*) * var_pop(label) * count(*) + 1e-8) AS ic
  FROM pa GROUP BY date, bar) WHERE n >= 2"""
SQL["j05_snapshot_ic"] = query(f"SELECT n_snapshots, {qs('snapshot_ic')} FROM ({SNAP})", "pa")
SQL["j06_objective"] = query(f"""SELECT kind, {qs('mse', 'corr', 'objective')} FROM (SELECT kind, mse, corr, mse + 0.5 * (1 - corr) AS objective FROM (
  SELECT 'pooled' AS kind, avg((pred - label) * (pred - label)) AS mse,
    covar_pop(pred, label) * count(*) / sqrt(var_pop(pred) * count(*) * var_pop(label) * count(*) + 1e-8) AS corr FROM pa
  UNION ALL SELECT 'snapshot', avg((pred - label) * (pred - label)), (SELECT snapshot_ic FROM ({SNAP})) FROM pa))""", "pa")
ROOT = "sqrt(var_pop(pred) * count(*) * var_pop(label) * count(*))"
SQL["j07_robust_pearson"] = scored(
    {"corr": f"CASE WHEN count(*) >= 2 AND {ROOT} >= 1e-8 THEN covar_pop(pred, label) * count(*) / {ROOT} ELSE 0.0 END"},
    "tall", "experiment_id, date")

# fold metrics straight from the repeated rows
cte("on_folds", ("tall", "fold_days"), "SELECT tall.*, profile, fold_id, segment FROM tall JOIN fold_days USING (date)")
G = "profile, fold_id, experiment_id"
cte("seg", "on_folds", f"""SELECT {G}, segment, {columns(POOLED)}, count(*) AS n_rows, count(DISTINCT date) AS n_days
  FROM on_folds GROUP BY {G}, segment""")
cte("seg_ic", "on_folds", f"""SELECT {G}, coalesce(avg(ic), 0.0) AS daily_corr_mean, coalesce(stddev_pop(ic), 0.0) AS daily_corr_std
  FROM (SELECT {G}, date, {corr('pred', 'label')} AS ic FROM on_folds WHERE segment = 'val' GROUP BY {G}, date) GROUP BY {G}""")
cte("fm", ("seg", "seg_ic"), f"""SELECT t.profile, t.fold_id, t.experiment_id, t.corr AS train_corr, t.mse AS train_mse, t.r2 AS train_r2,
  v.corr AS val_corr, v.mse AS val_mse, v.r2 AS val_r2, daily_corr_mean, daily_corr_std, t.corr - v.corr AS train_val_corr_gap,
  v.n_rows AS n_val_rows FROM seg t JOIN seg v USING ({G}) JOIN seg_ic USING ({G}) WHERE t.segment = 'train' AND v.segment = 'val'""")
SQL["a16_pending_fold_jobs"] = query(f"SELECT {G} FROM fm WHERE NOT (val_corr > 0)", "fm")
SQL["a17_pending_seed_folds"] = query("""SELECT fold_id, val_start, seed FROM (SELECT fold_id, val_start, unnest([42, 43, 44]) AS seed
  FROM fold_table WHERE profile = 'expanding_12d_3d') WHERE (fold_id + seed) % 2 = 1""", "fold_table")
SQL["j08_train_val_gap"] = query(f"SELECT {G}, {qs('train_val_corr_gap')} FROM fm", "fm")
SQL["j09_fold_summary"] = query(f"""SELECT profile, experiment_id, n_folds, {qs('mean', 'std', 'min', 'max', 'positive_rate')} FROM (
  SELECT profile, experiment_id, count(*) AS n_folds, avg(val_corr) AS mean, stddev_pop(val_corr) AS std, min(val_corr) AS min,
  max(val_corr) AS max, avg(CASE WHEN val_corr > 0 THEN 1.0 ELSE 0.0 END) AS positive_rate FROM fm GROUP BY profile, experiment_id)""", "fm")
SUM = {"rolling_corr_mean": "avg(val_corr)", "rolling_corr_std": "stddev_pop(val_corr)", "rolling_corr_min": "min(val_corr)",
       "rolling_corr_median": "median(val_corr)", "positive_fold_rate": "avg(CASE WHEN val_corr > 0 THEN 1.0 ELSE 0.0 END)",
       "stability_score": "avg(val_corr) - 0.7 * stddev_pop(val_corr)", "rolling_mse_mean": "avg(val_mse)",
       "rolling_mse_std": "stddev_pop(val_mse)", "rolling_r2_mean": "avg(val_r2)", "rolling_r2_min": "min(val_r2)",
       "daily_mean": "avg(daily_corr_mean)", "daily_std": "avg(daily_corr_std)",
       "train_val_corr_gap_mean": "avg(train_val_corr_gap)", "runtime_sec_sum": "CAST(sum(n_val_rows) AS DOUBLE)"}
cte("summ", "fm", f"""SELECT profile, experiment_id, count(*) AS n_folds, {columns(SUM)}, CASE split_part(profile, '_', 1)
  WHEN 'short' THEN 0.25 WHEN 'medium' THEN 0.35 WHEN 'long' THEN 0.25 ELSE 0.15 END AS w FROM fm GROUP BY profile, experiment_id""")
SUMQ = [q("daily_mean", "daily_corr_mean") if n == "daily_mean" else q("daily_std", "daily_corr_std") if n == "daily_std" else q(n)
        for n in SUM]
SQL["j10_profile_summary"] = query(f"SELECT profile, experiment_id, n_folds, {', '.join(SUMQ)} FROM summ", "summ")
WAVG = {"protocol_corr_mean": "rolling_corr_mean", "protocol_stability_score": "stability_score", "protocol_corr_min": "rolling_corr_min",
        "protocol_mse_mean": "rolling_mse_mean", "protocol_r2_mean": "rolling_r2_mean",
        "protocol_positive_fold_rate": "positive_fold_rate", "protocol_daily_ic_mean": "daily_mean"}
wavg = lambda c: f"(sum(w * {c}) / sum(w))"
PROTOCOL = {n: wavg(c) for n, c in WAVG.items()} | {
    "protocol_daily_ic_ir": f"CASE WHEN abs({wavg('daily_std')}) > 1e-12 THEN {wavg('daily_mean')} / {wavg('daily_std')} END"}
cte("proto", "summ", f"SELECT experiment_id, {columns(PROTOCOL)} FROM summ GROUP BY experiment_id")
SQL["j11_protocol_scores"] = query(f"SELECT experiment_id, {qs(*PROTOCOL)} FROM proto", "proto")
SIDE = {"corr_mean": "rolling_corr_mean", "corr_std": "rolling_corr_std", "corr_min": "rolling_corr_min",
        "stability_score": "stability_score", "n_folds": "n_folds", "positive_fold_rate": "positive_fold_rate",
        "daily_corr_mean": "daily_mean", "daily_corr_std": "daily_std",
        "daily_ic_ir": "CASE WHEN abs(daily_std) > 1e-12 THEN daily_mean / daily_std END"}
PIVOT = {f"{x}_{n}": f"max(CASE WHEN split_part(profile, '_', 1) = '{x}' THEN {e} END)"
         for x in ("short", "medium", "long", "expanding") for n, e in SIDE.items()}
cte("sides", "summ", f"SELECT experiment_id, {columns(PIVOT)} FROM summ GROUP BY experiment_id")
cte("board", ("proto", "sides"), "SELECT * FROM proto JOIN sides USING (experiment_id)")
BASE = "R02_ridge_legacy_plus_norm_core"
DELTAS = {"baseline_delta_corr": "a.protocol_corr_mean - b.protocol_corr_mean",
          "baseline_delta_stability": "a.protocol_stability_score - b.protocol_stability_score",
          "baseline_delta_mse_pct": "(a.protocol_mse_mean - b.protocol_mse_mean) / CASE WHEN abs(b.protocol_mse_mean) > 1e-12 THEN abs(b.protocol_mse_mean) END",
          "baseline_delta_r2": "a.protocol_r2_mean - b.protocol_r2_mean"}
FLOATS = [*PROTOCOL, *[c for c in PIVOT if not c.endswith("_n_folds")], *DELTAS]
COUNTS = [c for c in PIVOT if c.endswith("_n_folds")]
SQL["j12_leaderboard"] = query(f"""SELECT experiment_id, {', '.join(COUNTS)}, {qs(*FLOATS)} FROM (
  SELECT a.*, {columns(DELTAS)} FROM board a, (SELECT * FROM board WHERE experiment_id = '{BASE}') b)""", "board")


def verdicts(base: str) -> str:
    gain = "(a.protocol_corr_mean - b.protocol_corr_mean)"
    gates = {
        "expanding_negative": "a.expanding_corr_mean < 0",
        "short_expanding_not_up": "NOT (a.short_corr_mean - b.short_corr_mean > 0 AND a.expanding_corr_mean - b.expanding_corr_mean > 0)",
        "long_down": "a.long_corr_mean - b.long_corr_mean < -0.006",
        "daily_ic_down": "a.protocol_daily_ic_mean - b.protocol_daily_ic_mean < -1e-6",
        "stability_down": "a.protocol_stability_score - b.protocol_stability_score < -1e-6",
    }
    for x in ("short", "long", "expanding"):
        gates[f"{x}_negative_fold"] = f"a.{x}_corr_min < -0.01 OR (a.{x}_corr_min < 0 AND b.{x}_corr_min >= 0)"
    failed = "concat_ws(',', " + ", ".join(f"CASE WHEN {g} THEN '{n}' END" for n, g in gates.items()) + ")"
    return f"""SELECT '{base}' AS against, a.experiment_id,
  CASE WHEN a.experiment_id = '{base}' THEN 'baseline' WHEN {gain} < 0.003 THEN 'reject' WHEN {gain} < 0.005 THEN 'review'
  WHEN a.expanding_corr_mean IS NULL THEN 'review' WHEN {failed} <> '' THEN 'review' ELSE 'promote' END AS decision,
  CASE WHEN a.experiment_id <> '{base}' AND {gain} >= 0.005 THEN {failed} ELSE '' END AS failed_gates
  FROM board a, (SELECT * FROM board WHERE experiment_id = '{base}') b"""


SQL["j13_verdicts"] = query(verdicts(BASE) + " UNION ALL " + verdicts("X1_book"), "board")
D = "(c.val_corr - b.val_corr)"
PAIR = {"delta_mean": f"avg({D})", "delta_se": f"stddev_samp({D}) / sqrt(count(*))",
        "t_stat": f"CASE WHEN stddev_samp({D}) > 0 THEN avg({D}) / (stddev_samp({D}) / sqrt(count(*))) END",
        "delta_gap": "avg(c.train_val_corr_gap - b.train_val_corr_gap)", "delta_daily_ic": "avg(c.daily_corr_mean - b.daily_corr_mean)",
        "delta_corr_min": "min(c.val_corr) - min(b.val_corr)"}
SQL["j14_paired_diagnosis"] = query(f"""SELECT profile, experiment_id, n_folds, n_up, n_down, {qs(*PAIR)} FROM (
  SELECT c.profile, c.experiment_id, count(*) AS n_folds, count(CASE WHEN {D} > 0 THEN 1 END) AS n_up,
  count(CASE WHEN {D} < 0 THEN 1 END) AS n_down, {columns(PAIR)}
  FROM fm c JOIN fm b ON c.profile = b.profile AND c.fold_id = b.fold_id AND b.experiment_id = '{BASE}'
  WHERE c.experiment_id <> '{BASE}' GROUP BY c.profile, c.experiment_id)""", "fm")
cte("jz", "joined", """SELECT joined.*, (pred_a - ma) / sa AS za, (pred_b - mb) / sb AS zb FROM joined,
  (SELECT avg(pred_a) AS ma, stddev_pop(pred_a) AS sa, avg(pred_b) AS mb, stddev_pop(pred_b) AS sb FROM joined)""")
cte("pairs", "jz", """SELECT 'a_b' AS pair, date, pred_a AS x, pred_b AS y FROM jz UNION ALL SELECT 'a_label', date, pred_a, label FROM jz
  UNION ALL SELECT 'b_label', date, pred_b, label FROM jz UNION ALL SELECT 'z_label', date, za * 0.5 + zb * 0.5, label FROM jz
  UNION ALL SELECT 'raw_label', date, pred_a * 0.5 + pred_b * 0.5, label FROM jz""")
SQL["j15_member_correlation"] = query(f"""SELECT pair, n_days, {qs('overall', *DAILY)} FROM (
  SELECT pair, {corr('x', 'y')} AS overall FROM pairs GROUP BY pair) JOIN (
  SELECT pair, count(*) AS n_days, {columns(DAILY)} FROM (SELECT pair, date, {corr('x', 'y')} AS ic FROM pairs GROUP BY pair, date)
  GROUP BY pair) USING (pair)""", "pairs")
BEST = """CASE WHEN 1 - rho * rho > 1e-12 AND (i1 * i1 + i2 * i2 - 2 * rho * i1 * i2) / (1 - rho * rho) > 0
  THEN sqrt((i1 * i1 + i2 * i2 - 2 * rho * i1 * i2) / (1 - rho * rho)) END"""
SQL["j16_best_linear_corr"] = query(f"""SELECT date, {qs('i1', 'i2', 'rho', 'best')} FROM (SELECT *, {BEST} AS best FROM (
  SELECT date, {corr('pred_a', 'label')} AS i1, {corr('pred_b', 'label')} AS i2, {corr('pred_a', 'pred_b')} AS rho
  FROM joined GROUP BY date))""", "joined")
SQL["j17_label_agreement"] = query(f"""SELECT n_join, {qs('label_max_abs_diff')} FROM (SELECT count(*) AS n_join,
  max(abs(pa.label - pb.label)) AS label_max_abs_diff FROM pa JOIN pb USING ({K}))""", "pa", "pb")
SQL["j18_feature_health"] = query("\nUNION ALL ".join(
    f"SELECT date, '{c}' AS feature, count(*) AS n_rows, CAST(sum(CASE WHEN abs({c}) < 'Infinity'::DOUBLE THEN 0 ELSE 1 END) AS BIGINT) AS n_bad, "
    f"{q(f'max(abs({c}))', 'max_abs')} FROM bars GROUP BY date" for c in RAW), "bars")

SQL["flagship_daily_ic"] = query(f"""SELECT date, n_rows, {qs('ic')} FROM (SELECT date, count(*) AS n_rows,
  coalesce({corr('order_pressure_cs_z', 'fret12')}, 0.0) AS ic FROM cross_z GROUP BY date)""", "cross_z")

# blends
SQL["k01_raw_mean"] = query(f"""SELECT {K}, n_members, {qs('pred')} FROM (SELECT {K}, avg(pred) AS pred, count(*) AS n_members
  FROM (SELECT * FROM pa UNION ALL SELECT * FROM pb) GROUP BY {K})""", "pa", "pb")
dz = lambda c: (f"(CASE WHEN stddev_pop({c}) OVER (PARTITION BY date) < 1e-12 THEN {c} - avg({c}) OVER (PARTITION BY date) "
                f"ELSE ({c} - avg({c}) OVER (PARTITION BY date)) / nullif(stddev_pop({c}) OVER (PARTITION BY date), 0) END)")
SQL["k02_daily_zscore_mean"] = query(
    f"SELECT {K}, {qs('pred')} FROM (SELECT {K}, ({dz('pred_a')} + {dz('pred_b')}) / 2 AS pred FROM pab)", "pab")
cte("jr", "jz", f"SELECT *, {rank('pred_a', '1')} AS ra, {rank('pred_b', '1')} AS rb FROM jz")
SQL["k03_weighted_blend"] = query(f"""SELECT {K}, {qs('blend_raw', 'blend_zscore', 'blend_rank')} FROM (SELECT {K},
  0.25 * pred_a + 0.75 * pred_b AS blend_raw, 0.25 * za + 0.75 * zb AS blend_zscore,
  0.25 * (ra - ma) / sa + 0.75 * (rb - mb) / sb AS blend_rank FROM jr,
  (SELECT avg(ra) AS ma, stddev_pop(ra) AS sa, avg(rb) AS mb, stddev_pop(rb) AS sb FROM jr))""", "jr")
SQL["k04_fallback_fusion"] = query(f"""SELECT {K}, {qs('fused')} FROM (SELECT pa.date, pa.symbol, pa.bar,
  coalesce(0.5 * pa.pred + 0.5 * pb.pred, pa.pred) AS fused FROM pa LEFT JOIN pb USING ({K}))""", "pa", "pb")
SQL["k05_clipped_predictions"] = query(f"""SELECT {K}, {qs('pred')} FROM (SELECT {K}, greatest(least(pred, hi), lo) AS pred FROM pa,
  (SELECT quantile_cont(pred, 0.01) AS lo, quantile_cont(pred, 1 - 0.01) AS hi FROM pa))""", "pa")
forms = lambda src: f"""SELECT *, (({rank('f', 'date, bar')}) - 0.5) * (SELECT stddev_samp(pred) FROM {src}) * 2 AS pred_rank_scaled,
  pred - avg(pred) OVER ({X}) AS pred_group_demean FROM (SELECT *, {f32('pred')} AS f FROM {src})"""
SQL["k06_normalized_forms"] = query(
    f"SELECT {K}, {qs('pred_rank_scaled', 'pred_group_demean')} FROM ({forms('pb')})", "pb")
GRID = []
for i, quant in enumerate(("0.001", "0.005", "0.01")):
    cte(f"clip{i}", "pb", f"""SELECT {K}, label, greatest(least(pred, hi), lo) AS pred FROM pb,
  (SELECT quantile_cont(pred, {quant}) AS lo, quantile_cont(pred, 1 - {quant}) AS hi FROM pb)""")
    cte(f"form{i}", f"clip{i}", forms(f"clip{i}"))
    mixes = [(f"clip_{float(quant):.3f}", "none", 1.0, "pred")]
    for alpha in (0.7, 0.8, 0.9):
        mixes.append((f"clip_rank_{float(quant):.3f}_{alpha:.1f}", "rank", alpha,
                      f"({alpha} * pred + (1 - {alpha}) * pred_rank_scaled)"))
        mixes.append((f"clip_neutral_{float(quant):.3f}_{alpha:.1f}", "neutral", alpha,
                      f"({alpha} * pred + (1 - {alpha}) * pred_group_demean)"))
    for name, kind, alpha, e in mixes:
        GRID.append(f"""SELECT '{name}' AS name, '{kind}' AS blend_kind, {quant} AS clip_q, {alpha} AS blend_alpha, {columns(POOLED)}
  FROM (SELECT label, {e} AS pred FROM form{i})""")
SQL["k07_postprocess_grid"] = query(
    "SELECT name, blend_kind, " + qs("clip_q", "blend_alpha", "corr", "mse", "r2") + " FROM (" + "\nUNION ALL ".join(GRID) + ")",
    "form0", "form1", "form2")
SQL["k08_weight_sweep"] = query(f"""SELECT {q('w', 'weight')}, {qs('corr', 'daily_ic_mean')} FROM (
  WITH g AS (SELECT w / 20.0 AS w FROM (SELECT unnest(generate_series(0, 20)) AS w)),
  r AS (SELECT w, date, label, w * pred_a + (1 - w) * pred_b AS x, w * za + (1 - w) * zb AS z FROM jz, g)
  SELECT w, corr, daily_ic_mean FROM (SELECT w, {corr('x', 'label')} AS corr FROM r GROUP BY w) JOIN
  (SELECT w, avg(ic) AS daily_ic_mean FROM (SELECT w, date, {corr('z', 'label')} AS ic FROM r GROUP BY w, date) GROUP BY w) USING (w))""", "jz")
REPORT = {}
for name, e in {"trad": "pred_a", "dl": "pred_b", "blend_raw": "(pred_a + pred_b) / 2", "blend_z": "za + zb"}.items():
    sse = f"sum((({e}) - label) * (({e}) - label))"
    REPORT |= {f"{name}_pearson": corr(f"({e})", "label"), f"{name}_r2": f"1 - {sse} / nullif(var_samp(label), 0) / count(*)",
               f"{name}_mse": f"{sse} / count(*)"}
REPORT["rho"] = corr("pred_b", "pred_a")
SQL["k09_blend_report"] = query(f"""SELECT n_join, {qs(*REPORT, 'theory_optimal', 'blend_gain')} FROM (SELECT *,
  {BEST.replace('i1', 'trad_pearson').replace('i2', 'dl_pearson')} AS theory_optimal, blend_raw_pearson - trad_pearson AS blend_gain FROM (
  SELECT count(*) AS n_join, {columns(REPORT)} FROM jz))""", "jz")
