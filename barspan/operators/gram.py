"""Linear models from second moments per date.

A ridge or elastic net needs its training rows only through counts, means and centred products, and these add
up: a fold is the sum of its dates, a spec a sub-block of the columns, a penalty one small solve. So one pass
over the features writes a block for each date, and every fold, spec, clip and penalty of a whole suite is
fitted and scored from the blocks: pooled correlation, error, explained variance and the daily information
coefficient of a linear prediction are functions of the same moments. Bars are read once, whatever the number
of folds, and rows in flight are dates, not bars.

Labels clipped at a fold's own quantiles are further columns of the blocks of its dates. Blocks are centred
before they are multiplied and merged by their means, so columns that differ by many orders of magnitude keep
their digits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barspan.functions.scalars import LABEL, R2_EPS, clean
from barspan.operators import labels, models
from barspan.operators.folds import Profile, fold_days, fold_table
from barspan.operators.specs import Spec
from barspan.plans.catalogue import CATALOGUE
from barspan.plans.tables import written

#: Dates whose blocks a task holds at a time; rows clustered by date need one.
MOST_HELD = 4
BLOCK_SCHEMA = "date long, targets array<string>, n double, mean array<double>, scatter array<double>, low array<double>, high array<double>"
#: Clipping of the label: a name and the quantiles of a fold's training rows, or None.
Clips = dict[str, tuple[float, float] | None]
DEFAULT_CLIP: Clips = {"p1_p99": labels.WINSORIZE}


@dataclass(frozen=True)
class Block:
    """Count, means, centred products and ranges of some rows."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Block:
        mean = x.mean(axis=0)
        z = x - mean
        return Block(float(len(x)), mean, z.T @ z, x.min(axis=0), x.max(axis=0))

    def part(self, at: np.ndarray | list[int]) -> Block:
        return Block(self.n, self.mean[at], self.scatter[np.ix_(at, at)], self.low[at], self.high[at])


def merged(blocks: Iterable[Block]) -> Block:
    """One block of all rows."""
    blocks = list(blocks)
    n = sum(b.n for b in blocks)
    mean = sum(b.n * b.mean for b in blocks) / n
    scatter = np.zeros_like(blocks[0].scatter)
    for b in blocks:
        off = b.mean - mean
        scatter += b.scatter + b.n * np.outer(off, off)
    return Block(n, mean, scatter, np.min([b.low for b in blocks], axis=0), np.max([b.high for b in blocks], axis=0))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows (date, targets, block) as the stored table."""
    flat = [(d, t, b.n, b.mean, b.scatter.ravel(), b.low, b.high) for d, t, b in rows]
    return pd.DataFrame(flat, columns=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])


def _block(row) -> Block:
    size = len(row.mean_)
    return Block(row.n, np.asarray(row.mean_), np.asarray(row.scatter).reshape(size, size), np.asarray(row.low), np.asarray(row.high))


def _rows(pdf: pd.DataFrame):
    return pdf.rename(columns={"mean": "mean_"}).itertuples(index=False)


def target_name(profile: str, fold_id: int, clip: str) -> str:
    return f"{profile}/{fold_id}/{clip}"


def date_blocks(features: DataFrame, columns: list[str], clipped: dict[int, list[tuple[str, float, float]]] | None = None) -> DataFrame:
    """One row per date: the block of ``columns``, the label and its clipped forms.

    ``clipped``: the (name, low, high) of each date, as many as folds that train on it. A date that lies in
    several tasks gives a partial block in each, which are merged by date.
    """
    clipped = clipped or {}
    values = F.array(*[clean(F.col(c)).cast("double") for c in [*columns, LABEL]])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Block] = {}

        def out(date: int) -> pa.RecordBatch:
            frame = _frame([(date, [LABEL, *[c[0] for c in clipped.get(date, [])]], held.pop(date))])
            return pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

        for batch in batches:
            dates = batch.column("date").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(dates), -1)
            for date in np.unique(dates).tolist():
                own = x[dates == date]
                limits = [np.clip(own[:, -1], low, high) for _, low, high in clipped.get(date, [])]
                block = Block.of(np.column_stack([own, *limits]))
                held[date] = merged([held.pop(date), block]) if date in held else block
                if len(held) > MOST_HELD:
                    yield out(next(iter(held)))
        for date in list(held):
            yield out(date)

    schema = pa.schema([("date", pa.int64()), ("targets", pa.list_(pa.string())), ("n", pa.float64()), *[(c, pa.list_(pa.float64())) for c in ("mean", "scatter", "low", "high")]])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(_rows(pdf))
        return _frame([(rows[0].date, rows[0].targets, merged(_block(r) for r in rows))])

    parts = features.select("date", values.alias("x")).mapInArrow(partial, BLOCK_SCHEMA)
    return parts.groupBy("date").applyInPandas(whole, BLOCK_SCHEMA)


# -- fits and scores from blocks ---------------------------------------------------------


def block_moments(block: Block, columns: list[str], target: str) -> models.Moments:
    """Moments of a block whose last column is the target; a column that doesn't vary has scale 1."""
    k = len(columns)
    varies = block.high[:k] > block.low[:k]
    spread = np.sqrt(np.where(varies, np.diag(block.scatter)[:k], 0.0) / block.n)
    scale = np.where(spread > 0, spread, 1.0)
    cross = np.where(varies, 1.0, 0.0) / scale
    return models.Moments(
        columns, [target], block.n, block.mean[:k], scale, block.mean[k:], block.scatter[:k, :k] * np.outer(cross, cross),
        block.scatter[:k, k:] * cross[:, None], block.scatter[k:, k:],
    )


def _line(block: Block, fit: models.LinearFit) -> tuple[float, float, float, float, float]:
    """Mean and variance of the prediction, its covariance with the label (the last column), the label's mean and variance."""
    b = fit.coef
    return (
        fit.intercept + b @ block.mean[:-1], b @ block.scatter[:-1, :-1] @ b / block.n,
        b @ block.scatter[:-1, -1] / block.n, block.mean[-1], block.scatter[-1, -1] / block.n,
    )


def correlation(block: Block, fit: models.LinearFit) -> float | None:
    """Pearson of prediction and label; None when a side is constant."""
    _, vp, cov, _, vy = _line(block, fit)
    steady = block.high[-1] <= block.low[-1] or not np.any((block.high[:-1] > block.low[:-1]) & (fit.coef != 0))
    return None if steady or vp <= 0 or vy <= 0 else float(cov / np.sqrt(vp * vy))


def scores(block: Block, fit: models.LinearFit) -> dict[str, float]:
    """corr, mse and r2 of the block's rows."""
    mp, vp, cov, my, vy = _line(block, fit)
    mse = max(vp - 2 * cov + vy, 0.0) + (mp - my) ** 2
    return {"corr": correlation(block, fit) or 0.0, "mse": float(mse), "r2": float(1.0 - mse * block.n / (vy * block.n + R2_EPS))}


def linear_fit(m: models.Moments, spec: Spec, alpha: float | None = None) -> models.LinearFit:
    params = dict(spec.params) | ({} if alpha is None else {"alpha": alpha})
    if spec.model == "ridge":
        return models.ridge(m, params.get("alpha", models.RIDGE_ALPHA))
    if spec.model == "elasticnet":
        return models.elastic_net(m, **params)
    raise ValueError(f"{spec.model!r} isn't fitted from second moments")


RESULT = (
    "profile string, fold_id long, experiment_id string, clip string, alpha double, train_corr double, train_mse double, train_r2 double, "
    "val_corr double, val_mse double, val_r2 double, daily_corr_mean double, daily_corr_std double, train_val_corr_gap double, "
    "n_train_days long, n_val_days long, intercept double, features array<string>, coef array<double>, status string, error_msg string"
)


def is_linear(spec: Spec) -> bool:
    """Whether blocks are all that a spec needs."""
    return spec.kind == "standard" and spec.target_mode == "raw" and spec.model in ("ridge", "elasticnet")


def evaluated(blocks: DataFrame, days: DataFrame, columns: list[str], specs: list[Spec], clips: Clips, alphas: list[float] | None = None) -> DataFrame:
    """Fits and scores of every (fold, spec, clip, alpha); one row each, with its coefficients.

    A group is the dates of one fold, so its size follows the calendar, not the bars.
    """
    at = {c: i for i, c in enumerate(columns)}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        profile, fold_id = pdf["profile"].iloc[0], int(pdf["fold_id"].iloc[0])
        rows = list(_rows(pdf.sort_values("date")))
        out = []
        for clip, limits in clips.items():
            wanted = LABEL if limits is None else target_name(profile, fold_id, clip)
            k = len(columns)
            train = merged(_block(r).part([*range(k), k, k + list(r.targets).index(wanted)]) for r in rows if r.segment == "train")
            daily = [_block(r).part([*range(k), k]) for r in rows if r.segment == "val"]
            val = merged(daily)
            for spec in specs:
                own = CATALOGUE.columns(spec.groups or None)
                mine = [at[c] for c in own]
                m = block_moments(train.part([*mine, k + 1]), own, wanted)
                seen, held, each = train.part([*mine, k]), val.part([*mine, k]), [b.part([*mine, k]) for b in daily]
                for alpha in alphas or [None]:
                    row = {"profile": profile, "fold_id": fold_id, "experiment_id": spec.experiment_id, "clip": clip, "status": "ok", "error_msg": ""}
                    row["alpha"] = alpha if alpha is not None else spec.params.get("alpha", models.RIDGE_ALPHA if spec.model == "ridge" else None)
                    try:
                        fit = linear_fit(m, spec, alpha)
                        row |= {f"train_{n}": v for n, v in scores(seen, fit).items()} | {f"val_{n}": v for n, v in scores(held, fit).items()}
                        ic = [c for c in (correlation(b, fit) for b in each) if c is not None]
                        row |= {"daily_corr_mean": float(np.mean(ic)) if ic else 0.0, "daily_corr_std": float(np.std(ic)) if ic else 0.0}
                        row |= {"intercept": fit.intercept, "features": own, "coef": fit.scaled_coef, "train_val_corr_gap": row["train_corr"] - row["val_corr"]}
                    except Exception as error:  # a broken spec must not stop the others
                        row |= {"status": "error", "error_msg": str(error)[:2000]}
                    row |= {"n_train_days": sum(r.segment == "train" for r in rows), "n_val_days": len(daily)}
                    out.append(row)
        return pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return blocks.join(days, "date").groupBy("profile", "fold_id").applyInPandas(fold, RESULT)


def clip_limits(bars: DataFrame, days: DataFrame, clips: Clips) -> dict[int, list[tuple[str, float, float]]]:
    """(name, low, high) of every clipped label, by date. As many entries as dates of folds and clips."""
    train, by = days.where(F.col("segment") == "train"), ["profile", "fold_id"]
    wanted = {f"{clip}/{side}": q for clip, limits in clips.items() if limits for side, q in zip(("low", "high"), limits)}
    if not wanted:
        return {}
    bounds = labels.fold_bounds(bars, train, by, wanted).collect()
    limits = {(r["profile"], r["fold_id"]): r for r in bounds}
    out: dict[int, list[tuple[str, float, float]]] = {}
    for r in train.select(*by, "date").orderBy("date", *by).collect():
        found = limits[r["profile"], r["fold_id"]]
        for clip in (c for c, q in clips.items() if q):
            out.setdefault(r["date"], []).append((target_name(r["profile"], r["fold_id"], clip), found[f"{clip}/low"], found[f"{clip}/high"]))
    return out


def linear_protocol(
    features: DataFrame, calendar: DataFrame, profiles: list[Profile], specs: list[Spec], clips: Clips | None = None,
    alphas: list[float] | None = None, max_folds: int | None = None,
) -> DataFrame:
    """Every fold of the profiles, spec, clip and alpha, from one pass over ``features`` for the blocks and one
    over its labels for the clips. Specs must be linear (``is_linear``)."""
    odd = [s.experiment_id for s in specs if not is_linear(s)]
    if odd:
        raise ValueError(f"not fitted from second moments: {odd}")
    clips = DEFAULT_CLIP if clips is None else clips
    columns = list(dict.fromkeys(c for s in specs for c in CATALOGUE.columns(s.groups or None)))
    days = fold_days(calendar, profiles)
    if max_folds is not None:
        days = days.where(F.col("fold_id") < max_folds)
    days = written(days, "fold_days")
    blocks = written(date_blocks(features, columns, clip_limits(features, days, clips)), "blocks")
    return written(evaluated(blocks, days, columns, specs, clips, alphas), "linear_results")


def with_folds(results: DataFrame, calendar: DataFrame, profiles: list[Profile]) -> DataFrame:
    """Results with the first and last day of each fold's segments."""
    tables = [fold_table(calendar, p).select("profile", "fold_id", "train_start", "train_end", "val_start", "val_end") for p in profiles]
    spans = tables[0]
    for t in tables[1:]:
        spans = spans.unionByName(t)
    return results.join(spans, ["profile", "fold_id"])


def weights(results: DataFrame) -> DataFrame:
    """One row per fold, spec and feature: standardized coefficient and its size."""
    pair = F.inline(F.arrays_zip("features", "coef")).alias("feature", "coef")
    rows = results.where(F.col("status") == "ok").select("profile", "fold_id", "experiment_id", "clip", "alpha", pair)
    return rows.withColumn("abs_coef", F.abs("coef"))


# -- single jobs on stored blocks ----------------------------------------------------------


def block_of(blocks: DataFrame, columns: list[str], dates: list[int]) -> Block:
    """The block of ``columns`` and the label over some dates; one row comes to the driver."""
    keep = len(columns) + 1

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame([(0, [LABEL], merged(_block(r).part(np.arange(keep)) for r in _rows(pdf)))])

    rows = blocks.where(F.col("date").isin(dates)).groupBy().applyInPandas(whole, BLOCK_SCHEMA).toPandas()
    if rows.empty:
        raise ValueError("no rows on these dates")
    return _block(next(_rows(rows)))


def fit_dates(blocks: DataFrame, columns: list[str], spec: Spec, dates: list[int], alpha: float | None = None) -> models.LinearFit:
    """A linear spec on all ``columns`` of the blocks, trained on some dates."""
    return linear_fit(block_moments(block_of(blocks, columns, dates), columns, LABEL), spec, alpha)


def score_dates(blocks: DataFrame, columns: list[str], fit: models.LinearFit, dates: list[int]) -> dict[str, float]:
    return scores(block_of(blocks, columns, dates), fit)
