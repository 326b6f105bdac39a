"""A summary of training jobs is no result when some of them failed."""

import pytest
from pyspark.sql import functions as F

from barspan.operators import gram, scans
from barspan.queries.model_queries import QUERIES


def _stages(spark, tmp_path, broken):
    def evaluate(point, fold_id, seed):
        if (fold_id, seed) == (1, 43):
            return broken()
        return 0.1, 0.0

    return scans.Stages(spark, evaluate, str(tmp_path / "j")), spark.range(3).select(F.col("id").alias("fold_id"))


def _raises():
    raise RuntimeError("no rows on one day")


@pytest.mark.parametrize("broken, said", [(_raises, "no rows on one day"), (lambda: (float("nan"), 0.0), "None")])
def test_failed_jobs_are_named(spark, tmp_path, broken, said):
    stages, folds = _stages(spark, tmp_path, broken)
    found = stages.validate({"a": 1}, folds, [42, 43])
    assert found["folds"].count() == 6 and found["certificate"].first()["n_folds"] == 5
    with pytest.raises(scans.JobsFailed, match=f"^1 jobs .*fold_id=1, seed=43: {said}"):
        scans.all_succeeded(found["folds"])


def test_whole_runs_pass(spark, tmp_path):
    stages, folds = _stages(spark, tmp_path, lambda: (0.2, 0.0))
    assert scans.all_succeeded(stages.validate({"a": 1}, folds, [42, 43])["folds"]).count() == 6


def test_validation_query_fails_with_its_jobs(spark, small_dir, monkeypatch):
    real, calls = gram.score_dates, []

    def score(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("a lost fold")
        return real(*args)

    monkeypatch.setattr(gram, "score_dates", score)
    with pytest.raises(scans.JobsFailed, match="a lost fold"):
        QUERIES["l05_validation"](spark, small_dir)
