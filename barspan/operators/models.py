"""Regressors fitted as Spark jobs.

Linear models need the data only through one matrix of second moments, which
tasks build with numpy on Arrow batches and Spark adds up; a small solve on the
driver follows. Forests come from ``extra_trees``, leaf-wise boosting
from ``boosting``, depth-wise boosting from Spark ML. Predictions are column expressions, vectorised functions or
ML transforms, so scoring is one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barspan.functions.scalars import KEYS, LABEL, total, zero
from barspan.operators import boosting, extra_trees, labels
from barspan.operators.extra_trees import Forest
from barspan.plans.tables import only_scanned
from barspan.sources.bars import Panel

RIDGE_ALPHA = 2.0


# -- second moments ----------------------------------------------------------------


@dataclass(frozen=True)
class Moments:
    """Second moments of population-standardized features and centred targets."""

    columns: list[str]
    targets: list[str]
    n: float
    mean: np.ndarray
    scale: np.ndarray
    target_mean: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray


def moments(df: DataFrame, columns: list[str], targets: list[str]) -> Moments:
    """Two passes: means and scales first, then products of centred values.

    Features may differ by 15 orders of magnitude, so nothing is summed raw. Each
    task sends one matrix, whatever its row count.
    """
    names = [*columns, *targets]
    x = {c: zero(F.col(c)).cast("double") for c in names}
    first = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.stddev_pop(x[c]).alias(f"s{i}") for i, c in enumerate(names)],
    ).first()
    n = float(first["n"])
    if n == 0:
        raise ValueError("no training rows")
    mean = np.array([first[f"m{i}"] for i in range(len(names))])
    scale = np.array([first[f"s{i}"] for i in range(len(names))])
    k = len(columns)
    scale[:k] = np.where(scale[:k] > 0, scale[:k], 1.0)
    scale[k:] = 1.0
    size = len(names)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((size, size))
        for batch in batches:
            z = (batch.to_numpy(dtype=np.float64) - mean) / scale
            acc += z.T @ z
        yield pd.DataFrame({"at": np.arange(size), "products": list(acc)})

    parts = df.select(*[x[c].alias(c) for c in names])
    parts = parts.mapInPandas(products, "at long, products array<double>")
    summed = parts.groupBy("at").agg(Summarizer.sum(array_to_vector("products")).alias("v"))
    rows = summed.select("at", vector_to_array("v").alias("v")).collect()
    whole = np.zeros((size, size))
    for row in rows:
        whole[row["at"]] = row["v"]
    return Moments(
        list(columns), list(targets), n, mean[:k], scale[:k], mean[k:], whole[:k, :k], whole[:k, k:], whole[k:, k:]
    )


# -- linear models -----------------------------------------------------------------


@dataclass(frozen=True)
class LinearFit:
    columns: list[str]
    coef: np.ndarray
    intercept: float
    scaled_coef: np.ndarray = field(repr=False, default=None)

    def expression(self) -> Column:
        terms = [F.lit(float(b)) * zero(F.col(c)) for c, b in zip(self.columns, self.coef) if b != 0.0]
        return total([F.lit(float(self.intercept)), *terms])

    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        return df.withColumn(name, self.expression())

    def weights(self, spark: SparkSession) -> DataFrame:
        """feature, coef, abs_coef on the standardized scale."""
        rows = [(c, float(b), abs(float(b))) for c, b in zip(self.columns, self.scaled_coef)]
        return spark.createDataFrame(rows, "feature string, coef double, abs_coef double")


def _unscaled(m: Moments, scaled: np.ndarray, target: int) -> LinearFit:
    coef = scaled / m.scale
    return LinearFit(m.columns, coef, float(m.target_mean[target] - coef @ m.mean), scaled)


def ridge(m: Moments, alpha: float = RIDGE_ALPHA, target: int = 0) -> LinearFit:
    """min ||y - Zb||^2 + alpha ||b||^2 on standardized features with intercept."""
    if alpha <= 0:
        raise ValueError("ridge alpha must be positive")
    return _unscaled(m, np.linalg.solve(m.xx + alpha * np.eye(len(m.columns)), m.xy[:, target]), target)


def least_squares(m: Moments, target: int = 0) -> LinearFit:
    return _unscaled(m, np.linalg.pinv(m.xx, hermitian=True) @ m.xy[:, target], target)


def elastic_net(
    m: Moments, alpha: float = 5e-4, l1_ratio: float = 0.1, target: int = 0, max_iter: int = 5000, tol: float = 1e-12
) -> LinearFit:
    """min ||y - Zb||^2 / 2n + alpha (l1 |b| + (1 - l1) ||b||^2 / 2), by
    coordinate descent on the moments: the data are not read again."""
    g, r = m.xx / m.n, m.xy[:, target] / m.n
    b = np.zeros(len(m.columns))
    soft, grow = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    for _ in range(max_iter):
        before = b.copy()
        for j in range(len(b)):
            if g[j, j] <= 0:
                continue
            rest = r[j] - g[j] @ b + g[j, j] * b[j]
            b[j] = np.sign(rest) * max(abs(rest) - soft, 0.0) / (g[j, j] + grow)
        if np.max(np.abs(b - before), initial=0.0) <= tol * max(1.0, np.max(np.abs(b), initial=0.0)):
            break
    return _unscaled(m, b, target)


def huber(
    df: DataFrame, columns: list[str], target: str, epsilon: float = 1.35, alpha: float = 1e-4, max_iter: int = 100
) -> LinearFit:
    """Huber regression with Spark ML on standardized features."""
    m = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(zero(F.col(c))).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(zero(F.col(c))).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    mean = np.array([m[f"m{i}"] for i in range(len(columns))])
    scale = np.array([m[f"s{i}"] or 1.0 for i in range(len(columns))])
    scaled = [
        ((zero(F.col(c)) - F.lit(float(mean[i]))) / F.lit(float(scale[i]))).alias(f"z{i}")
        for i, c in enumerate(columns)
    ]
    rows = df.select(*scaled, F.col(target).alias("label"))
    vectors = VectorAssembler(inputCols=[f"z{i}" for i in range(len(columns))], outputCol="features").transform(rows)
    fitted = LinearRegression(
        loss="huber", epsilon=epsilon, regParam=2.0 * alpha / max(m["n"], 1), standardization=False, maxIter=max_iter
    ).fit(vectors.select("features", "label"))
    b = fitted.coefficients.toArray()
    coef = b / scale
    return LinearFit(list(columns), coef, float(fitted.intercept - coef @ mean), b)


# -- trees -------------------------------------------------------------------------

# The presets of the extra-random forests, and of boosting in Spark ML parameter names.
FORESTS = {
    "tree": Forest(trees=40, depth=16, least_rows=50, column_share=0.3, sample_share=0.7),
    "tree_big": Forest(trees=120, depth=20, least_rows=20, column_share=0.5, sample_share=0.8),
    "tree_shallow": Forest(trees=300, depth=5, least_rows=500, column_share=0.4, sample_share=0.7),
}
BOOSTED = {
    "gbdt": dict(maxIter=30, stepSize=0.05, maxDepth=2, minInstancesPerNode=200, subsamplingRate=0.8),
    "histgb": dict(maxIter=200, stepSize=0.05, maxDepth=8, minInstancesPerNode=50),
    "histgb_shallow": dict(maxIter=300, stepSize=0.05, maxDepth=4, minInstancesPerNode=200),
}
LEAF_WISE = {"lgbm"}
EARLY_STOPPED = {"histgb", "histgb_shallow"}
VALIDATION_SHARE = 0.1
TREE_SEED = 42
LINEAR = {"ridge", "elasticnet", "huber"}


@dataclass(frozen=True)
class TreeFit:
    columns: list[str]
    model: object

    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        vectors = _vectors(df, self.columns)
        return self.model.transform(vectors).withColumnRenamed("_tree", name).drop("_features")

    def weights(self, spark: SparkSession) -> DataFrame:
        shares = self.model.featureImportances.toArray()
        rows = [(c, float(b), float(b)) for c, b in zip(self.columns, shares)]
        return spark.createDataFrame(rows, "feature string, coef double, abs_coef double")


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("_features", array_to_vector(F.array(*[zero(F.col(c)).cast("double") for c in columns])))


def fit_trees(
    df: DataFrame, columns: list[str], target: str, name: str, params: dict | None = None, packed: str | None = None
) -> TreeFit | extra_trees.ForestFit:
    if name in FORESTS:
        identity = KEYS if set(KEYS) <= set(df.columns) else None
        return extra_trees.fit_forest(df, columns, target, extra_trees.settings(FORESTS[name], params), identity, packed)
    common = dict(featuresCol="_features", labelCol=target, predictionCol="_tree", seed=TREE_SEED)
    rows = _vectors(df, columns)
    model = GBTRegressor(**common, **(BOOSTED[name] | (params or {})))
    if name in EARLY_STOPPED:
        held = labels.sample_key(TREE_SEED) < F.lit(VALIDATION_SHARE * 2**52)
        rows = rows.withColumn("_held", held)
        model = model.setValidationIndicatorCol("_held")
    return TreeFit(list(columns), model.fit(rows))


# -- one model by name ---------------------------------------------------------------


@dataclass(frozen=True)
class ZeroFit:
    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        return df.withColumn(name, F.lit(0.0))


@dataclass(frozen=True)
class BaselinedFit:
    """A fit on labels minus their per-bar mean; predicting adds the mean back."""

    fit: object
    baseline: DataFrame

    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        scored = labels.attach_baseline(self.fit.predict(df, name), self.baseline)
        return scored.withColumn(name, F.col(name) + F.col("interval_mean")).drop("interval_mean")


def fit_columns(df: DataFrame, columns: list[str], target: str, name: str, params: dict | None = None, packed: str | None = None):
    """Fit by model name on a target that is already built; ``packed`` names the column that holds a forest's columns."""
    params = dict(params or {})
    if name == "ridge":
        return ridge(moments(df, columns, [target]), params.get("alpha", RIDGE_ALPHA))
    if name == "elasticnet":
        return elastic_net(moments(df, columns, [target]), **params)
    if name == "huber":
        return huber(df, columns, target, **params)
    if name in LEAF_WISE:
        return boosting.boost(df, columns, target, boosting.settings(params))
    if name in FORESTS or name in BOOSTED:
        return fit_trees(df, columns, target, name, params, packed)
    raise ValueError(f"unknown model {name!r}")


def fit_model(
    panel: Panel,
    train: DataFrame,
    columns: list[str],
    name: str,
    target_mode: str = "raw",
    params: dict | None = None,
    winsor: tuple[float, float] | None = labels.WINSORIZE,
    sample: float | None = None,
):
    """Sample (trees only), build the target, clip it, fit. Validation is untouched.

    A fit reads its rows several times, so they are kept for its duration, unless
    they lie in a table; a lost executor recomputes its part from the feature plan.
    Forests see float columns: these go through the target's shuffle as one array.
    """
    kept = [extra_trees.packed(columns).alias("_x")] if name in FORESTS else columns
    train, stored = train.select(*KEYS, LABEL, *kept), only_scanned(train)
    if not stored:
        train = train.persist()
    try:
        rows = labels.sample_rows(train, sample, model=name)
        baseline = labels.interval_baseline(rows) if target_mode == "interval_residual" else None
        rows = labels.with_target(panel, rows, target_mode, "_target")
        if winsor is not None:
            rows = labels.winsorize(rows, "_target", *winsor, fits_task=panel.total_fits)
        fit = fit_columns(rows, columns, "_target", name, params, "_x" if name in FORESTS else None)
    finally:
        if not stored:
            train.unpersist()
    return fit if baseline is None else BaselinedFit(fit, baseline)


# -- small fits as aggregations --------------------------------------------------------


def ols_rescale(df: DataFrame, by: list[str], pred: str = "pred", label: str = "label") -> DataFrame:
    """a, b of label = a pred + b per group: 1, 0 for fewer than two rows and
    0, mean(label) for a constant prediction."""
    x, y, n = F.col(pred), F.col(label), F.count(F.lit(1))
    flat = F.var_pop(x) * n < F.lit(1e-12)
    slope = F.when(n < 2, F.lit(1.0)).when(flat, F.lit(0.0)).otherwise(
        F.try_divide(F.covar_pop(x, y), F.when(~flat, F.var_pop(x)))
    )
    out = df.groupBy(*by).agg(slope.alias("a"), n.alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    b = F.when(F.col("_n") < 2, F.lit(0.0)).otherwise(F.col("_my") - F.col("a") * F.col("_mx"))
    return out.withColumn("b", b).drop("_n", "_mx", "_my")


def apply_rescale(df: DataFrame, fitted: DataFrame, by: list[str], pred: str = "pred") -> DataFrame:
    return df.join(fitted, by).withColumn(pred, F.col("a") * F.col(pred) + F.col("b")).drop("a", "b")


def seed_average(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean prediction per key over the seeds that scored it."""
    return rows.groupBy(*keys).agg(F.avg("pred").alias("pred_dl"), F.count(F.lit(1)).alias("n_seeds"))


def interval_onehot_ridge(rows: DataFrame, label: str, alpha: float = 10.0) -> DataFrame:
    """Ridge on one-hot bars of the day with an unpenalized intercept.

    With one indicator per bar the solution is closed: the intercept c makes
    sum n_k (m_k - c) alpha / (n_k + alpha) vanish and each bar shrinks its mean
    towards it. Returns bar and pred; unseen bars predict c, the row with bar null.
    """
    per_bar = rows.groupBy("bar").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(label).alias("m"))
    weight = F.col("n") / (F.col("n") + F.lit(alpha))
    centre = per_bar.agg((F.sum(weight * F.col("m")) / F.sum(weight)).alias("c"))
    shrunk = F.col("c") + weight * (F.col("m") - F.col("c"))
    fitted = per_bar.withColumn("c", centre.select("c").scalar()).select("bar", shrunk.alias("pred"))
    return fitted.unionByName(centre.select(F.lit(None).cast("bigint").alias("bar"), F.col("c").alias("pred")))


# -- importances ------------------------------------------------------------------------


def feature_family(name: Column) -> Column:
    """Family of a feature by its name; the order of the rules matters."""
    has, starts = (lambda s: name.contains(s)), (lambda s: name.startswith(s))
    return (
        F.when(has("_x_"), "interaction")
        .when(name.endswith("_cs_rank"), "cross_rank")
        .when(name.endswith("_cs_z"), "cross_z")
        .when(has("regime") | starts("state_"), "regime")
        .when(starts("lagret") | has("_lag_") | starts("lag"), "momentum")
        .when(has("_rm") | has("_rs") | has("roll"), "roll")
        .when(has("ofi"), "ofi")
        .when(starts("trade") | starts("avg_trade") | has("trade_"), "trade")
        .when(has("patch"), "patch")
        .otherwise("base")
    )


def family_importance(weights: DataFrame) -> DataFrame:
    """Totals, counts, best and share per family. One row per feature comes in."""
    tagged = weights.withColumn("family", feature_family(F.col("feature")))
    whole = weights.agg(F.sum("abs_coef").alias("s")).select("s").scalar()
    return tagged.groupBy("family").agg(
        F.sum("abs_coef").alias("importance_sum"),
        F.count("feature").alias("n_features"),
        F.max("abs_coef").alias("top_importance"),
    ).withColumn("importance_share", F.try_divide(F.col("importance_sum"), whole))
