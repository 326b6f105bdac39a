"""Scans over training choices: label clips and ridge strengths, added features,
and the two-tier sweep of a search space. Loops run over a few dozen jobs; the
work on bars is in the Spark jobs they start."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from barspan.functions.scalars import FLAT_STD
from barspan.operators import gram, search
from barspan.operators.folds import Profile
from barspan.operators.metrics import STABILITY_PENALTY
from barspan.operators.protocol import groups_of, run_profile, shared_features
from barspan.operators.specs import Spec
from barspan.plans.tables import fresh_path
from barspan.sources.bars import Panel
from barspan.sources.journal import Journal

# The scanned ridge strengths and label clips.
ALPHAS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0]
CLIPS = {"off": None, "p1_p99": (0.01, 0.99), "p0.5_p99.5": (0.005, 0.995)}


def ridge_scan(
    panel: Panel, calendar: DataFrame, profile: Profile, groups: list[str], alphas: list[float] | None = None,
    clips: gram.Clips | None = None, max_folds: int | None = None,
) -> DataFrame:
    """Score every (clip, alpha) on the folds, best first.

    Features are computed once and read once: all folds, clips and strengths are solved and scored from their
    second moments per date.
    """
    spec = Spec("scan", tuple(groups))
    results = gram.linear_protocol(
        shared_features(panel, groups), calendar, [profile], [spec], clips or CLIPS, alphas or ALPHAS, max_folds
    )
    out = results.where(F.col("status") == "ok").groupBy("clip", "alpha").agg(
        F.avg("val_corr").alias("corr_mean"),
        F.stddev_pop("val_corr").alias("corr_std"),
        F.avg("daily_corr_mean").alias("daily_ic_mean"),
        F.avg("daily_corr_std").alias("daily_ic_std"),
        F.count(F.lit(1)).alias("n_folds"),
    )
    spread = F.when(F.col("daily_ic_std") > FLAT_STD, F.col("daily_ic_std"))
    out = out.withColumns(
        {
            "daily_ic_ir": F.try_divide(F.col("daily_ic_mean"), spread),
            "stability_score": F.col("corr_mean") - F.lit(STABILITY_PENALTY) * F.col("corr_std"),
        }
    )
    return out.orderBy(
        F.desc("corr_mean"), F.desc_nulls_last("daily_ic_ir"), F.desc("stability_score"), "clip", "alpha"
    )


PROBED = ("val_corr", "val_r2", "val_mse", "daily_corr_mean")


def feature_probe(
    panel: Panel, calendar: DataFrame, profile: Profile, old: Spec, new: Spec, max_folds: int | None = None, **options
) -> DataFrame:
    """Per fold: scores with and without a set of columns, and their differences. Two linear specs share one
    pass over the features; others are trained fold by fold."""
    if gram.is_linear(old) and gram.is_linear(new):
        features = options.get("features")
        features = shared_features(panel, groups_of([old, new])) if features is None else features
        results = gram.linear_protocol(features, calendar, [profile], [old, new], max_folds=max_folds)
    else:
        results = run_profile(panel, calendar, profile, [old, new], max_folds, **options)
    pick = lambda s, tag: results.where(F.col("experiment_id") == s.experiment_id).select(
        "fold_id", *[F.col(c).alias(f"{tag}_{c}") for c in PROBED]
    )
    both = pick(old, "old").join(pick(new, "new"), "fold_id")
    return both.withColumns({f"delta_{c}": F.col(f"new_{c}") - F.col(f"old_{c}") for c in PROBED})


# -- stages of a search ----------------------------------------------------------------

#: One training job: ``evaluate(point, fold_id, seed)`` gives the validation correlation and R2.
Evaluate = Callable[[dict, int, int], tuple[float, float]]
TRIAL_JOB = ["stage", "trial_id", "fold_id", "seed"]
TRIAL_SCHEMA = (
    "stage string, trial_id long, fold_id long, seed long, corr double, val_r2 double, status string, error_msg string, "
    "runtime_sec double"
)
SEARCH, VALIDATION, SCREENING, CERTIFICATION, DELIVERY = "search", "validation", "sweep_screen", "sweep_cert", "sweep_delivery"


class Stages:
    """Search, validation and sweep over one journal.

    A job is one training run, named by stage, trial, fold and seed. ``workers`` jobs are in flight, each
    leaves one row, and a run that broke off goes on with the jobs that have no ``ok`` row. A trial's number
    depends on the space alone, so a resumed run finds its trials again. ``most`` bounds the jobs that one
    call starts; ``BrokenOff`` is raised when some are left.
    """

    def __init__(self, spark: SparkSession, evaluate: Evaluate, results: str | None = None, workers: int = 1, most: int | None = None):
        self.spark, self.evaluate, self.workers, self.left = spark, evaluate, workers, most
        self.journal = Journal(spark, results or fresh_path(spark, "trials"), TRIAL_JOB, TRIAL_SCHEMA)

    def _run(self, stage: str, points: dict[int, dict], jobs: DataFrame) -> DataFrame:
        listed = [{"stage": stage, **r.asDict()} for r in jobs.orderBy("trial_id", "fold_id", "seed").collect()]

        def work(job: dict) -> dict:
            corr, r2 = self.evaluate(points[job["trial_id"]], job["fold_id"], job["seed"])
            return {"corr": float(corr), "val_r2": float(r2)}

        before = self.journal.finished()
        rows = self.journal.run(listed, work, self.workers, self.left)
        if self.left is not None:
            self.left -= sum(tuple(j[k] for k in TRIAL_JOB) not in before for j in listed)
        return rows

    def search(self, trials: DataFrame, folds: DataFrame, seeds: list[int]) -> dict[str, DataFrame]:
        """Every trial (trial_id and one column per knob) on all folds and seeds; the best mean wins."""
        points = {r["trial_id"]: r.asDict() for r in trials.collect()}
        slots = folds.select("fold_id", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
        found = search.trial_table(self._run(SEARCH, points, search.all_pairs(trials.select("trial_id"), slots)))
        return {"trials": found, "best": search.best_trial(found).join(trials, "trial_id")}

    def validate(self, point: dict, folds: DataFrame, seeds: list[int]) -> dict[str, DataFrame]:
        """One frozen configuration on all folds and seeds; failed folds are reported and not counted."""
        jobs = folds.select(F.lit(0).cast("long").alias("trial_id"), "fold_id", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
        rows = self._run(VALIDATION, {0: point}, jobs)
        return {"folds": rows, "certificate": search.certificate(_as_folds(rows))}

    def sweep(
        self, space: dict, folds: DataFrame, seeds: list[int], overrides: dict | None = None, delivery_fold: int | None = None
    ) -> dict[str, DataFrame]:
        """The grid on the latest folds, the champion (by its worst fold) on all folds and seeds, and the delivery
        fold with the first seed, which is reported and never ranked."""
        grid = search.grid(self.spark, space, overrides)
        points = {r["trial_id"]: r.asDict() for r in grid.collect()}
        trials = search.trial_table(self._run(SCREENING, points, search.screening_jobs(grid.select("trial_id"), folds, seeds)))
        best = search.champion(trials)
        out = {"trials": trials, "champion": best}
        rows = self._run(CERTIFICATION, points, search.certification_jobs(best, folds, seeds))
        if delivery_fold is not None:
            last = best.select("trial_id", F.lit(delivery_fold).cast("long").alias("fold_id"), F.lit(seeds[0]).cast("long").alias("seed"))
            out["delivery"] = self._run(DELIVERY, points, last)
            rows = rows.unionByName(out["delivery"])
        return out | {"folds": _as_folds(rows), "certificate": search.certificate(_as_folds(rows))}


class JobsFailed(RuntimeError):
    """A summary was asked for of jobs of which some failed or left no finite score."""


def all_succeeded(rows: DataFrame) -> DataFrame:
    """Job rows of which every one is ``ok`` with a finite correlation; otherwise an error that names the others."""
    scored = (F.col("status") == "ok") & F.coalesce(F.abs("corr") < F.lit(float("inf")), F.lit(False))
    bad = rows.where(~scored).orderBy(*TRIAL_JOB).collect()
    if bad:
        first = bad[0]
        job = ", ".join(f"{k}={first[k]}" for k in TRIAL_JOB)
        raise JobsFailed(f"{len(bad)} jobs have no score, the first of them {job}: {first['error_msg'] or first['corr']}")
    return rows


def _as_folds(rows: DataFrame) -> DataFrame:
    """Job rows as fold rows: the stage is the profile, the correlation a validation score."""
    return rows.withColumns({"profile": F.col("stage"), "val_corr": F.col("corr")})


def run_sweep(
    spark: SparkSession, space: dict, folds: DataFrame, seeds: list[int], evaluate: Evaluate, overrides: dict | None = None,
    results: str | None = None, workers: int = 1, most: int | None = None, delivery_fold: int | None = None,
) -> dict[str, DataFrame]:
    """``Stages.sweep`` in one call."""
    return Stages(spark, evaluate, results, workers, most).sweep(space, folds, seeds, overrides, delivery_fold)
