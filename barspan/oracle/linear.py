"""Ridge fits over folds as SQL: second moments, elimination, predictions, scores."""

from __future__ import annotations

from barspan.functions.scalars import R2_EPS
from barspan.oracle.protocol import DAILY, POOLED
from barspan.oracle.text import columns as listed, corr, cte, q, query
from barspan.plans.catalogue import CATALOGUE

SQL: dict[str, str] = {}
FOLD = "profile, fold_id"
JOB = f"{FOLD}, seed, clip, alpha"
Limits = tuple[float, float] | None


def ridge(
    tag: str, source: str, names: list[str], profiles: list[str], alphas: list[float] = [2.0], clips: dict[str, Limits] = {"p1_p99": (0.01, 0.99)},
    seeds: list[int] = [0], days: str = "fold_days",
) -> None:
    """CTEs ``tag``_b (coefficients) and ``tag``_r (scores) of every fold, seed, clip and alpha.

    A seed s > 0 leaves out the training dates with date + s divisible by 7.
    """
    k, x = len(names), [f"x{i}" for i in range(1, len(names) + 1)]
    shown = ", ".join(f"'{p}'" for p in profiles)
    cte(f"{tag}_x", (source, days), f"""SELECT {FOLD}, seed, segment, s.date, s.fret12 AS label,
  {', '.join(f"coalesce(s.{c}, 0.0) AS {n}" for c, n in zip(names, x))}
  FROM {source} s JOIN {days} f ON f.date = s.date, (SELECT unnest([{', '.join(map(str, seeds))}]) AS seed)
  WHERE profile IN ({shown}) AND NOT (segment = 'train' AND seed > 0 AND (s.date + seed) % 7 = 0)""")
    bounds = [
        f"SELECT {FOLD}, seed, '{c}' AS clip, " + ("'-Infinity'::DOUBLE AS lo, 'Infinity'::DOUBLE AS hi" if limits is None else
        f"quantile_cont(label, {limits[0]}) AS lo, quantile_cont(label, {limits[1]}) AS hi") + f" FROM {tag}_x WHERE segment = 'train' GROUP BY {FOLD}, seed"
        for c, limits in clips.items()
    ]
    cte(f"{tag}_q", f"{tag}_x", "\nUNION ALL ".join(bounds))
    pair = lambda i, j: f"covar_pop({x[min(i, j)]}, {x[max(i, j)]})"
    cte(f"{tag}_z", (f"{tag}_x", f"{tag}_q"), f"""SELECT {FOLD}, seed, clip, CAST(count(*) AS DOUBLE) AS n, avg(y) AS my,
  [{', '.join(f'avg({c})' for c in x)}] AS m, [{', '.join(f'CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END' for c in x)}] AS s,
  [{', '.join(f'covar_pop({c}, y)' for c in x)}] AS cy, [{', '.join('[' + ', '.join(pair(i, j) for j in range(k)) + ']' for i in range(k))}] AS cc
  FROM (SELECT a.*, clip, greatest(least(label, hi), lo) AS y FROM {tag}_x a JOIN {tag}_q USING ({FOLD}, seed) WHERE segment = 'train')
  GROUP BY {FOLD}, seed, clip""")
    # Gauss-Jordan without pivoting: the matrix is positive definite.
    cte(f"{tag}_b", f"{tag}_z", f"""WITH RECURSIVE solve({FOLD}, seed, clip, alpha, p, a) AS (
  SELECT {FOLD}, seed, clip, alpha, 1, [list_append([n * cc[i][j] / (s[i] * s[j]) + CASE WHEN i = j THEN alpha ELSE 0.0 END FOR j IN range(1, {k + 1})], n * cy[i] / s[i]) FOR i IN range(1, {k + 1})]
  FROM {tag}_z, (SELECT CAST(unnest([{', '.join(map(str, alphas))}]) AS DOUBLE) AS alpha)
  UNION ALL
  SELECT {FOLD}, seed, clip, alpha, p + 1, [CASE WHEN i = p THEN [v / a[p][p] FOR v IN a[p]] ELSE [a[i][j] - a[i][p] / a[p][p] * a[p][j] FOR j IN range(1, {k + 2})] END FOR i IN range(1, {k + 1})]
  FROM solve WHERE p <= {k})
  SELECT {FOLD}, seed, clip, alpha, n, my, m, s, [r[{k + 1}] FOR r IN a] AS b FROM solve JOIN {tag}_z USING ({FOLD}, seed, clip) WHERE p = {k + 1}""")
    terms = " + ".join(f"b[{i}] * ({c} - m[{i}]) / s[{i}]" for i, c in enumerate(x, 1))
    cte(f"{tag}_p", (f"{tag}_x", f"{tag}_b"), f"SELECT {JOB}, segment, date, label, my + {terms} AS pred FROM {tag}_x JOIN {tag}_b USING ({FOLD}, seed)")
    pooled = POOLED | {"r2": POOLED["r2"].replace("1e-8", repr(R2_EPS))}
    cte(f"{tag}_g", f"{tag}_p", f"SELECT {JOB}, segment, count(DISTINCT date) AS n_days, {listed(pooled)} FROM {tag}_p GROUP BY {JOB}, segment")
    daily = {n: DAILY[n] for n in ("daily_corr_mean", "daily_corr_std")}
    cte(f"{tag}_d", f"{tag}_p", f"""SELECT {JOB}, {listed(daily)} FROM (SELECT {JOB}, date, {corr('pred', 'label')} AS ic
  FROM {tag}_p WHERE segment = 'val' GROUP BY {JOB}, date) GROUP BY {JOB}""")
    cte(f"{tag}_r", (f"{tag}_g", f"{tag}_d"), f"""SELECT t.*, daily_corr_mean, daily_corr_std FROM (
  SELECT a.{JOB.replace(', ', ', a.')}, a.corr AS train_corr, a.mse AS train_mse, a.r2 AS train_r2, v.corr AS val_corr, v.mse AS val_mse, v.r2 AS val_r2,
    a.corr - v.corr AS train_val_corr_gap, a.n_days AS n_train_days, v.n_days AS n_val_days
  FROM {tag}_g a JOIN {tag}_g v USING ({JOB}) WHERE a.segment = 'train' AND v.segment = 'val') t JOIN {tag}_d USING ({JOB})""")


SCORES = ["train_corr", "train_mse", "train_r2", "val_corr", "val_mse", "val_r2", "daily_corr_mean", "daily_corr_std", "train_val_corr_gap"]
qs = lambda *names: ", ".join(q(n) for n in names)

LEGACY, CORE, MICRO = (CATALOGUE.columns(list(g)) for g in (("legacy",), ("legacy", "norm_core"), ("legacy", "rx_micro")))
ridge("r0", "group_set", LEGACY, ["short_8d_2d", "medium_20d_5d"])
ridge("r2", "group_set", CORE, ["short_8d_2d", "medium_20d_5d"])
cte("with_micro", ("group_set", "rx"), f"SELECT g.date, g.fret12, {', '.join(f'g.{c}' for c in LEGACY)}, "
    f"{', '.join(f'r.{c}' for c in MICRO if c not in LEGACY)} FROM group_set g JOIN rx r USING (date, symbol, bar)")
ridge("rm", "with_micro", MICRO, ["medium_20d_5d"])


def run(tag: str, experiment: str, where: str = "true") -> str:
    return f"SELECT {FOLD}, '{experiment}' AS experiment_id, n_train_days, n_val_days, {qs(*SCORES)} FROM {tag}_r WHERE {where}"


SHORT = "profile = 'short_8d_2d'"
SQL["h14_protocol_run"] = query(run("r0", "R00_ridge_legacy", SHORT), "r0_r")
SQL["h14_resumed_run"] = SQL["h14_protocol_run"]
SQL["h14_gram_run"] = query(run("r0", "R00_ridge_legacy") + "\nUNION ALL " + run("r2", "R02_ridge_legacy_plus_norm_core"), "r0_r", "r2_r")
SQL["h14_coefficients"] = query(f"""SELECT {FOLD}, experiment_id, feature, {q('coef * 1e6', 'coef')}, {q('abs(coef) * 1e6', 'abs_coef')} FROM (
  SELECT {FOLD}, 'R00_ridge_legacy' AS experiment_id, unnest([{', '.join(f"'{c}'" for c in LEGACY)}]) AS feature, unnest(b) AS coef FROM r0_b
  UNION ALL SELECT {FOLD}, 'R02_ridge_legacy_plus_norm_core', unnest([{', '.join(f"'{c}'" for c in CORE)}]), unnest(b) FROM r2_b)""", "r0_b", "r2_b")

# ridge scan
ridge("rs", "group_set", LEGACY, ["short_8d_2d"], [0.1, 0.5, 1.0, 2.0, 5.0, 10.0], {"off": None, "p1_p99": (0.01, 0.99), "p0.5_p99.5": (0.005, 0.995)})
SQL["l07_ridge_scan"] = query(f"""SELECT clip, n_folds, {qs('alpha', 'corr_mean', 'daily_ic_mean', 'stability_score')} FROM (
  SELECT clip, alpha, count(*) AS n_folds, avg(val_corr) AS corr_mean, avg(daily_corr_mean) AS daily_ic_mean,
    avg(val_corr) - 0.7 * stddev_pop(val_corr) AS stability_score FROM rs_r GROUP BY clip, alpha)""", "rs_r")
SQL["l10_feature_probe"] = query(f"""SELECT fold_id, {qs('old_val_corr', 'new_val_corr', 'delta_val_corr', 'old_val_mse', 'new_val_mse')} FROM (
  SELECT o.fold_id, o.val_corr AS old_val_corr, n.val_corr AS new_val_corr, n.val_corr - o.val_corr AS delta_val_corr, o.val_mse AS old_val_mse, n.val_mse AS new_val_mse
  FROM r0_r o JOIN rm_r n USING ({FOLD}) WHERE profile = 'medium_20d_5d')""", "r0_r", "rm_r")

# stages of a search: alpha by grid, seeds leave out training dates, a delivery fold behind the others
ALPHAS, SEEDS, N_SHORT = [0.5, 2.0, 200.0], [42, 43, 44], "(SELECT max(fold_id) FROM fold_days WHERE profile = 'short_8d_2d')"
cte("stage_days", ("fold_days", "days"), f"""SELECT * FROM fold_days WHERE profile = 'short_8d_2d'
  UNION ALL SELECT 'short_8d_2d', {N_SHORT} + 1, day, CASE WHEN day <= 20240124 THEN 'train' ELSE 'val' END FROM days WHERE day <> 20240125""")
ridge("st", "group_set", LEGACY, ["short_8d_2d"], ALPHAS, {"off": None}, SEEDS, "stage_days")
cte("st_rows", ("st_r", "fold_days"), f"SELECT list_position([{', '.join(f'{a}::DOUBLE' for a in ALPHAS)}], alpha) - 1 AS trial_id, fold_id, seed, val_corr AS corr, val_r2, {N_SHORT} AS last FROM st_r")
TRIAL = """coalesce(avg(corr), 0.0) AS screen_corr_mean, coalesce(min(corr), 0.0) AS screen_corr_min, coalesce(stddev_pop(corr), 0.0) AS screen_corr_std, count(corr) AS n_evals"""
cte("st_screen", "st_rows", f"SELECT trial_id, {TRIAL} FROM st_rows WHERE fold_id BETWEEN last - 1 AND last AND seed IN (42, 43) GROUP BY trial_id")
cte("st_best", "st_screen", "SELECT trial_id FROM st_screen ORDER BY screen_corr_min DESC, screen_corr_mean DESC, trial_id LIMIT 1")
cte("st_folds", ("st_rows", "st_best"), """SELECT CASE WHEN fold_id > last THEN 'sweep_delivery' ELSE 'sweep_cert' END AS profile, trial_id, fold_id, seed, corr, val_r2
  FROM st_rows WHERE trial_id = (SELECT trial_id FROM st_best) AND (fold_id <= last OR seed = 42)""")
SQL["l04_sweep_folds"] = query(f"SELECT profile, trial_id, fold_id, seed, {qs('corr', 'val_r2')} FROM st_folds", "st_folds")
CERTIFICATE = {"mean": "coalesce(avg(corr), 0.0)", "std": "coalesce(stddev_pop(corr), 0.0)", "min": "min(corr)", "max": "max(corr)",
               "positive_rate": "avg(CASE WHEN corr > 0 THEN 1.0 ELSE 0.0 END)", "val_r2_mean": "avg(val_r2)", "val_r2_min": "min(val_r2)"}
certificate = lambda source: f"SELECT n_folds, {qs(*CERTIFICATE)} FROM (SELECT count(corr) AS n_folds, {listed(CERTIFICATE)} FROM {source})"
SQL["l04_sweep_certificate"] = query(certificate("(SELECT * FROM st_folds WHERE profile = 'sweep_cert')"), "st_folds")
SQL["l05_search_trials"] = query(f"""SELECT pick, trial_id, n_evals, {qs('screen_corr_mean', 'screen_corr_min', 'screen_corr_std')} FROM (
  WITH t AS (SELECT trial_id, {TRIAL} FROM st_rows WHERE fold_id <= last AND seed IN (42, 43) GROUP BY trial_id)
  SELECT 'all' AS pick, t.* FROM t UNION ALL (SELECT 'best', t.* FROM t ORDER BY screen_corr_mean DESC, trial_id LIMIT 1))""", "st_rows")
SQL["l05_validation"] = query(certificate("(SELECT * FROM st_rows WHERE trial_id = 1 AND fold_id <= last)"), "st_rows")

# the first leaf-wise tree: the best of all cuts, then the better of the best cuts of its two sides
COUNTS = ["nTradeBuy", "nTradeSell", "nAddBuy", "nAddSell", "nCxlBuy", "nCxlSell"]
PENALTY, RIDGE, LEAST = "1e-4", "0.1", 50
shrunk = lambda g: f"(sign({g}) * greatest(abs({g}) - {PENALTY}, 0.0))"
gain = lambda g, n: f"({shrunk(g)} * {shrunk(g)} / ({n} + {RIDGE}))"
cte("tree_rows", "bars", f"""SELECT date, symbol, bar, {', '.join(COUNTS)}, (SELECT avg(fret12) FROM bars WHERE date BETWEEN 20240101 AND 20240120) - fret12 AS g,
  date BETWEEN 20240101 AND 20240120 AS used FROM bars""")


def cuts(source: str, by: str) -> str:
    """All cuts of the rows of each group, best first, with the sums of both sides."""
    tall = " UNION ALL ".join(f"SELECT {by}, {k} AS k, {c} AS v, g FROM {source} WHERE used" for k, c in enumerate(COUNTS))
    return f"""SELECT *, {gain('gl', 'nl')} + {gain('(gp - gl)', '(np - nl)')} - {gain('gp', 'np')} AS gain FROM (
  SELECT {by}, k, v, sum(sg) OVER (PARTITION BY {by}, k ORDER BY v) AS gl, sum(n) OVER (PARTITION BY {by}, k ORDER BY v) AS nl,
    sum(sg) OVER (PARTITION BY {by}, k) AS gp, sum(n) OVER (PARTITION BY {by}, k) AS np
  FROM (SELECT {by}, k, v, sum(g) AS sg, CAST(count(*) AS DOUBLE) AS n FROM ({tall}) GROUP BY {by}, k, v)) WHERE nl >= {LEAST} AND np - nl >= {LEAST}"""


value = f"-{shrunk('gp')} / (np + {RIDGE})"
chosen = lambda cut: "CASE " + " ".join(f"WHEN {cut}.k = {k} THEN {c}" for k, c in enumerate(COUNTS)) + f" END <= {cut}.v"
cte("tree_root", "tree_rows", f"SELECT * FROM ({cuts('(SELECT *, 0 AS side FROM tree_rows)', 'side')}) ORDER BY gain DESC, k, v LIMIT 1")
cte("tree_sides", ("tree_rows", "tree_root"), f"SELECT r.*, CASE WHEN {chosen('t')} THEN 0 ELSE 1 END AS side FROM tree_rows r, tree_root t")
cte("tree_next", "tree_sides", f"SELECT * FROM ({cuts('tree_sides', 'side')}) WHERE gain > 0 ORDER BY gain DESC, side, k, v LIMIT 1")
cte("tree_leaves", ("tree_sides", "tree_next"), f"""SELECT r.*, CASE WHEN r.side <> t.side THEN 0 WHEN {chosen('t')} THEN 1 ELSE 2 END AS leaf
  FROM tree_sides r, tree_next t""")
SQL["h05_first_tree"] = query(f"""SELECT date, symbol, bar, {q('pred')} FROM (SELECT date, symbol, bar, base + {value} AS pred FROM tree_leaves
  JOIN (SELECT leaf, sum(g) AS gp, count(*) AS np FROM tree_leaves WHERE used GROUP BY leaf) USING (leaf),
  (SELECT avg(fret12) AS base FROM bars WHERE date BETWEEN 20240101 AND 20240120))""", "bars", "tree_leaves")


# -- three extra-random trees on the order counts: cuts between the ends of a node's columns, drawn by a digest -------


def random_split(level: str) -> str:
    """Rows of a level with the node they go to: the doubled path, plus one above the cut."""
    tall = " UNION ALL ".join(f"SELECT tree, path, {k} AS k, CAST({c} AS DOUBLE) AS x, y FROM {level} WHERE used" for k, c in enumerate(COUNTS))
    drawn = "CAST('0x' || substr(md5('42:' || tree || ':' || path || ':' || k || ':cut'), 1, 13) AS BIGINT) / 4503599627370496.0"
    ends = f"SELECT tree, path, k, min(x) AS lo, max(x) AS hi, count(*) AS n, sum(y) AS s FROM ({tall}) GROUP BY tree, path, k"
    nodes = f"SELECT *, lo + {drawn} * (hi - lo) AS cut FROM ({ends}) WHERE lo < hi AND n >= 100"
    sums = f"""SELECT tree, path, k, cut, n, s, count(*) AS nl, sum(y) AS sl FROM ({tall}) JOIN ({nodes}) USING (tree, path, k)
      WHERE x <= cut GROUP BY tree, path, k, cut, n, s"""
    gains = f"""SELECT tree, path, k, cut, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM ({sums})
      WHERE nl >= 50 AND n - nl >= 50"""
    best = f"""SELECT tree, path, arg_min(k, k) AS k, arg_min(cut, k) AS cut FROM (
      SELECT *, max(gain) OVER (PARTITION BY tree, path) AS top FROM ({gains})) WHERE top > 0 AND gain >= top * (1 - 1e-9) GROUP BY tree, path"""
    own = "CASE k " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(COUNTS)) + " END"
    return f"""SELECT r.* REPLACE (CASE WHEN k IS NULL THEN r.path WHEN {own} <= cut THEN 2 * r.path ELSE 2 * r.path + 1 END AS path)
      FROM {level} r LEFT JOIN ({best}) b ON r.tree = b.tree AND r.path = b.path"""


cte("cuts_0", "bars", f"""SELECT CAST(t AS BIGINT) AS tree, CAST(1 AS BIGINT) AS path, date, symbol, bar, {', '.join(COUNTS)}, base, fret12 - base AS y,
  date BETWEEN 20240101 AND 20240120 AS used FROM bars, (SELECT unnest(generate_series(0, 2)) AS t),
  (SELECT avg(fret12) AS base FROM bars WHERE date BETWEEN 20240101 AND 20240120)""")
cte("cuts_1", "cuts_0", random_split("cuts_0"))
cte("cuts_2", "cuts_1", random_split("cuts_1"))
SQL["h04_random_cuts"] = query(f"""SELECT date, symbol, bar, {q('pred')} FROM (SELECT date, symbol, bar, avg(base + value) AS pred FROM cuts_2
  JOIN (SELECT tree, path, avg(y) AS value FROM cuts_2 WHERE used GROUP BY tree, path) USING (tree, path) GROUP BY date, symbol, bar)""", "cuts_2")
