"""Store, models and search as SQL, where SQL can state them."""

from __future__ import annotations

from barspan.oracle.features import CROSS
from barspan.oracle.protocol import GROUP, K, POOLED
from barspan.oracle.text import P, columns, corr, cte, q, query
from barspan.plans.catalogue import CATALOGUE

SQL: dict[str, str] = {}


def qs(*names: str) -> str:
    return ", ".join(q(n) for n in names)


BASE = ["spread", "mid_ret1_raw", "obi0", "obi4", "obi9", "trade_imb", "trade_imbema5", "trade_turnover_imb", "add_imb",
        "cxl_imb", "qty_add_imb", "qty_cxl_imb", "buy_vwad_gap", "sell_vwad_gap", "bret12", "lagret12", "ob_imb0", "ob_imb4",
        "ob_imb9", "trade_activity", "order_pressure"]
f32 = lambda c: f"CAST(CAST({c} AS FLOAT) AS DOUBLE)"
SQL["a06_stage_round_trip"] = query(
    f"SELECT {K}, {qs(*BASE)} FROM (SELECT {K}, {columns({c: f32(c) for c in BASE})} FROM base)", "base")
SQL["a07_loaded_groups"] = query(
    f"SELECT {K}, {qs(*GROUP)} FROM (SELECT {K}, fret12, {columns({c: f32(c) for c in GROUP if c != 'fret12'})} FROM group_set)",
    "group_set")
SQL["a08_alignment"] = query(
    "SELECT CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_extra FROM (SELECT count(*) FROM bars)", "bars")
SQL["a08_verified_dates"] = query("""SELECT kind, date, CAST(n + CASE WHEN date % 3 <> 0 THEN 0 ELSE extra END AS BIGINT) AS n_left, n AS n_right,
  CAST(CASE WHEN kind = 'whole' OR date % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS same FROM (SELECT date, count(*) AS n FROM bars GROUP BY date),
  (VALUES ('whole', 0), ('changed', 0), ('missing', -1), ('doubled', 1)) AS k(kind, extra)""", "bars")
SQL["a09_stale_stages"] = query("""SELECT step, code, CASE WHEN code = 'days' THEN CAST(n - n // 2 AS VARCHAR) ELSE '' END AS detail,
  CAST(CASE step WHEN 'new' THEN 0 WHEN 'half' THEN n // 2 ELSE n END AS BIGINT) AS n_days FROM (SELECT count(DISTINCT date) AS n FROM bars),
  (VALUES ('new', 'unrecorded'), ('half', 'unrecorded'), ('more', 'days'), ('again', 'ok'), ('version', 'version'), ('force', 'forced')) AS s(step, code)""",
  "bars")
SQL["a10_incremental_build"] = query("""SELECT date, count(*) AS n_stored, count(*) AS n_wanted, CAST(1 AS BIGINT) AS same FROM bars
  GROUP BY date""", "bars")
SQL["a12_appended_predictions"] = query(f"""SELECT experiment_id, fold_id, n_rows, {q('pred')} FROM (SELECT experiment_id, fold_id,
  count(*) AS n_rows, avg(pred) AS pred FROM tall JOIN fold_days USING (date) WHERE profile = 'short_8d_2d' AND segment = 'val'
  AND experiment_id IN ('R02_ridge_legacy_plus_norm_core', 'X1_book') GROUP BY experiment_id, fold_id)""", "tall", "fold_days")
STORED = CATALOGUE.columns(["base"])
SQL["i09_stored_vectors"] = query(f"SELECT {K}, {qs(*[f'x_{c}' for c in STORED], 'label')} FROM (SELECT {K}, "
    f"{columns({f'x_{c}': f'coalesce({f32(c)}, 0.0)' for c in STORED})}, coalesce(fret12, 0.0) AS label FROM base)", "base")
SIZES = {"base": 21, "ofi": 46, "rx_micro": 49, "lag": 24, "roll": 50, "patch": 140, "regime": 11, "trade_impact": 90,
         "cross": 38, "conditional_momentum": 43}
SQL["a11_store_status"] = query("SELECT stage, state, reason, CAST(CASE WHEN state = 'ok' THEN n ELSE 0 END AS BIGINT) AS n_days, "
    "CAST(n_columns AS BIGINT) AS n_columns FROM (SELECT count(DISTINCT date) AS n FROM bars), (VALUES " + ", ".join(
        f"('{s}', '{'ok' if s == 'rx_micro' else 'dirty'}', '{'' if s == 'rx_micro' else 'unrecorded'}', {n})"
        for s, n in SIZES.items()) + ") AS t(stage, state, reason, n_columns)", "bars")
SQL["a13_member_round_trip"] = query(f"""SELECT fold_id, {K}, {qs('fret12', 'pred')} FROM (SELECT fold_id, {K}, label AS fret12, pred
  FROM tall JOIN fold_days USING (date) WHERE profile = 'short_8d_2d' AND segment = 'val' AND experiment_id = 'X1_book')""",
  "tall", "fold_days")
SQL["a14_scored_rows"] = query(f"SELECT {K}, {qs('label', 'pred')} FROM pb", "pb")

# ridge on two columns by Cramer's rule; elastic net on one column by soft thresholding
cte("ridge_z", "base", """SELECT count(*) AS n, avg(obi0) AS m1, stddev_pop(obi0) AS s1, avg(trade_imb) AS m2, stddev_pop(trade_imb) AS s2,
  avg(fret12) AS my, covar_pop(obi0, trade_imb) AS c12, covar_pop(obi0, fret12) AS c1y, covar_pop(trade_imb, fret12) AS c2y
  FROM base WHERE date BETWEEN 20240101 AND 20240120""")
cte("ridge_b", "ridge_z", """SELECT *, ((n + 2.0) * r1 - g * r2) / ((n + 2.0) * (n + 2.0) - g * g) AS b1,
  ((n + 2.0) * r2 - g * r1) / ((n + 2.0) * (n + 2.0) - g * g) AS b2 FROM (
  SELECT *, n * c12 / (s1 * s2) AS g, n * c1y / s1 AS r1, n * c2y / s2 AS r2 FROM ridge_z)""")
SQL["h01_ridge"] = query(f"""SELECT {K}, {qs('pred')} FROM (SELECT {K},
  my + b1 * (obi0 - m1) / s1 + b2 * (trade_imb - m2) / s2 AS pred FROM base, ridge_b)""", "base", "ridge_b")
SQL["h02_elastic_net"] = query(f"""SELECT {K}, {qs('pred')} FROM (SELECT {K}, my + b * (obi0 - m1) / s1 AS pred FROM base,
  (SELECT *, sign(c1y / s1) * greatest(abs(c1y / s1) - 1e-7 * 0.1, 0) / (1 + 1e-7 * 0.9) AS b FROM ridge_z))""", "base", "ridge_z")
FAMILY = """CASE WHEN contains(feature, '_x_') THEN 'interaction' WHEN ends_with(feature, '_cs_rank') THEN 'cross_rank'
  WHEN ends_with(feature, '_cs_z') THEN 'cross_z' WHEN contains(feature, 'regime') OR starts_with(feature, 'state_') THEN 'regime'
  WHEN starts_with(feature, 'lagret') OR contains(feature, '_lag_') OR starts_with(feature, 'lag') THEN 'momentum'
  WHEN contains(feature, '_rm') OR contains(feature, '_rs') OR contains(feature, 'roll') THEN 'roll'
  WHEN contains(feature, 'ofi') THEN 'ofi'
  WHEN starts_with(feature, 'trade') OR starts_with(feature, 'avg_trade') OR contains(feature, 'trade_') THEN 'trade'
  WHEN contains(feature, 'patch') THEN 'patch' ELSE 'base' END"""
IMPORTANT = [c for c in BASE if c != "bret12"] + [f"{c}_cs_z" for c in CROSS]
SQL["h06_family_importance"] = query(f"""SELECT family, n_features, {qs('importance_sum', 'top_importance', 'importance_share')} FROM (
  SELECT family, count(*) AS n_features, sum(v) AS importance_sum, max(v) AS top_importance,
  sum(v) / (SELECT sum(v) FROM w) AS importance_share FROM (SELECT *, {FAMILY} AS family FROM w) GROUP BY family)""".replace(
  "FROM (\n  SELECT family", "FROM (WITH w AS (" + " UNION ALL ".join(
      f"SELECT '{c}' AS feature, abs(coalesce({corr(c, 'fret12')}, 0.0)) AS v FROM group_set" for c in IMPORTANT) + ")\n  SELECT family", 1),
  "group_set")
SQL["c06_feature_families"] = query(f"""SELECT feature, {FAMILY} AS family, CAST((SELECT count(*) FROM bars) AS BIGINT) AS n_rows
  FROM (SELECT unnest([{', '.join(f"'{c}'" for c in CATALOGUE.columns())}]) AS feature)""", "bars")
SQL["h09_interval_ridge"] = query(f"""SELECT bar, {qs('pred')} FROM (WITH k AS (SELECT bar, CAST(count(*) AS DOUBLE) AS n, avg(fret12) AS m FROM bars GROUP BY bar),
  c AS (SELECT sum(n / (n + 10) * m) / sum(n / (n + 10)) AS c FROM k)
  SELECT bar, c + n / (n + 10) * (m - c) AS pred FROM k, c UNION ALL SELECT NULL, c FROM c)""", "bars")
SQL["h10_rescaled"] = query(f"""SELECT experiment_id, {K}, {qs('pred')} FROM (SELECT experiment_id, {K}, a * pred + b AS pred FROM tall JOIN (
  SELECT experiment_id, regr_slope(label, pred) AS a, regr_intercept(label, pred) AS b FROM tall
  WHERE date BETWEEN 20240101 AND 20240120 GROUP BY experiment_id) USING (experiment_id))""", "tall")
# least squares on two channels by Cramer's rule, on the last step and on the window mean
cte("win", "bars", f"""SELECT date, symbol, bar, fret12 AS label, bsize0 AS l1, asize0 AS l2,
  avg(bsize0) OVER w AS a1, avg(asize0) OVER w AS a2, row_number() OVER ({P}) AS rn FROM bars
  WINDOW w AS ({P} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")


def plane(u: str, v: str) -> str:
    det = f"(var_pop({u}) * var_pop({v}) - covar_pop({u}, {v}) * covar_pop({u}, {v}))"
    return f"""SELECT b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM (SELECT avg({u}) AS m1, avg({v}) AS m2, avg(label) AS my,
  (covar_pop({u}, label) * var_pop({v}) - covar_pop({v}, label) * covar_pop({u}, {v})) / {det} AS b1,
  (covar_pop({v}, label) * var_pop({u}) - covar_pop({u}, label) * covar_pop({u}, {v})) / {det} AS b2
  FROM win WHERE rn >= 6 AND date BETWEEN 20240101 AND 20240120)"""


SQL["h11_reference_models"] = query(f"""SELECT model, {qs('mse', 'corr', 'r2')} FROM (SELECT model, {columns(POOLED)} FROM (
  SELECT 'zero' AS model, label, 0.0 AS pred FROM win WHERE rn >= 6
  UNION ALL SELECT 'last_step', label, b0 + b1 * l1 + b2 * l2 FROM win, ({plane('l1', 'l2')}) WHERE rn >= 6
  UNION ALL SELECT 'window_mean', label, b0 + b1 * a1 + b2 * a2 FROM win, ({plane('a1', 'a2')}) WHERE rn >= 6) GROUP BY model)""", "win")
SQL["h13_seed_average"] = query(f"""SELECT {K}, n_seeds, {qs('pred_dl')} FROM (SELECT {K}, count(*) AS n_seeds, avg(pred * w) AS pred_dl
  FROM pb, (VALUES (0.9), (1.0), (1.2)) AS s(w) GROUP BY {K})""", "pb")

# trials
cte("trials", ("pab", "fold_days"), f"""SELECT trial_id, coalesce(avg(c), 0.0) AS screen_corr_mean,
  coalesce(min(c), 0.0) AS screen_corr_min, coalesce(stddev_pop(c), 0.0) AS screen_corr_std, count(c) AS n_evals FROM (
  SELECT trial_id, fold_id, {corr('pred', 'label')} AS c FROM (
    SELECT CAST(t AS BIGINT) AS trial_id, fold_id, label, t / 4.0 * pred_a + (1 - t / 4.0) * pred_b AS pred FROM pab
    JOIN fold_days USING (date), (SELECT unnest(generate_series(0, 4)) AS t)
    WHERE profile = 'short_8d_2d' AND segment = 'val') GROUP BY trial_id, fold_id) GROUP BY trial_id""")
TRIAL = qs("screen_corr_mean", "screen_corr_min", "screen_corr_std")
SQL["l03_best_trial"] = query(f"""SELECT 'all' AS pick, trial_id, n_evals, {TRIAL} FROM trials UNION ALL
  SELECT * FROM (SELECT 'best', trial_id, n_evals, {TRIAL} FROM trials t WHERE n_evals > 0
  ORDER BY t.screen_corr_mean DESC, trial_id LIMIT 1)""", "trials")
SQL["l04_champion"] = query(f"""SELECT trial_id, n_evals, {TRIAL} FROM trials t WHERE n_evals > 0
  ORDER BY t.screen_corr_min DESC, t.screen_corr_mean DESC, trial_id LIMIT 1""", "trials")
SQL["l06_early_stop"] = query("""SELECT experiment_id, count(*) AS n,
  CAST(CASE WHEN count(*) >= 3 AND min(CASE WHEN rn >= 3 THEN mse END) > 3e-6 * 1.5 THEN 1 ELSE 0 END AS BIGINT) AS stop FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY date) AS rn FROM (
    SELECT experiment_id, date, avg((pred - label) * (pred - label)) AS mse FROM tall GROUP BY experiment_id, date))
  GROUP BY experiment_id""", "tall")
SQL["c07_member_tokens"] = query(f"""SELECT {K}, 'run_' || date AS run_id, 'exp_' || symbol AS experiment_id,
  CAST(symbol AS VARCHAR) AS alpha, CAST(bar AS VARCHAR) AS depth FROM bars""", "bars")

SQL["h07_lambda_grid"] = query(f"""SELECT {qs('weight', 'corr', 'mse', 'r2')} FROM (SELECT weight, corr, mse * 1e9 AS mse, r2 FROM (
  SELECT weight, {columns(POOLED)} FROM (SELECT weight, fret12 AS label, residual + weight * common AS pred FROM (
    SELECT fret12, common, pred_b + pred_a - common AS residual FROM (SELECT *, avg(pred_a) OVER (PARTITION BY date, bar) AS common FROM (
      SELECT date, symbol, bar, fret12, midpx / open - 1 AS pred_a, (bsize0 - asize0) / (bsize0 + asize0) / 1000 AS pred_b FROM bars))),
    (VALUES (0.1), (0.2), (0.3), (0.5), (0.8), (1.0)) AS l(weight)) GROUP BY weight))""", "bars")
