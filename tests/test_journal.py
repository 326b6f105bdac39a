"""The job journal: concurrent, idempotent, resumable."""

import threading

import pytest

from barspan.sources.journal import BrokenOff, Journal

SCHEMA = "stage string, trial long, score double, status string, error_msg string, runtime_sec double"
KEY = ["stage", "trial"]


def journal(spark, tmp_path):
    return Journal(spark, str(tmp_path / "journal"), KEY, SCHEMA)


def jobs(n):
    return [{"stage": "one", "trial": k} for k in range(n)]


def test_rows_of_many_threads(spark, tmp_path):
    made = journal(spark, tmp_path)
    assert made.rows().collect() == [] and made.finished() == set()
    threads = [threading.Thread(target=lambda k=k: made.record({"stage": "one", "trial": k % 20, "score": k % 20 / 3, "status": "ok"})) for k in range(60)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = {r["trial"]: r["score"] for r in made.rows().collect()}
    assert rows == {k: k / 3 for k in range(20)}  # doubles come back exactly
    assert made.all_rows().count() == 20 and made.clear_attempts() == 0


def test_half_written_rows_are_not_seen(spark, tmp_path):
    made = journal(spark, tmp_path)
    made.record({"stage": "one", "trial": 1, "status": "ok"})
    (tmp_path / "journal" / "_attempt-left").write_text('{"stage": "one", "trial": 2, "sta')
    assert made.finished() == {("one", 1)}
    assert made.clear_attempts() == 1 and made.finished() == {("one", 1)}


def test_run_breaks_off_and_resumes(spark, tmp_path):
    made, calls = journal(spark, tmp_path), []

    def work(job):
        calls.append(job["trial"])
        return {"score": float(job["trial"])}

    with pytest.raises(BrokenOff):
        made.run(jobs(10), work, workers=4, most=3)
    assert len(made.finished()) == 3
    rows = journal(spark, tmp_path).run(jobs(10), work, workers=4)
    assert sorted(calls) == list(range(10))
    assert {r["trial"]: r["score"] for r in rows.collect()} == {k: float(k) for k in range(10)}
    assert all(r["status"] == "ok" and r["runtime_sec"] is not None for r in rows.collect())


def test_failed_jobs_run_again(spark, tmp_path):
    made, broken = journal(spark, tmp_path), {3, 4}

    def work(job):
        if job["trial"] in broken:
            raise ValueError(f"broken {job['trial']}")
        return {"score": 1.0}

    rows = {r["trial"]: r for r in made.run(jobs(6), work, workers=3).collect()}
    assert rows[3]["status"] == "error" and rows[3]["error_msg"] == "broken 3" and rows[5]["status"] == "ok"
    broken.clear()
    assert {r["status"] for r in made.run(jobs(6), work, workers=3).collect()} == {"ok"}
    assert made.all_rows().where("status = 'error'").count() == 2  # what went wrong stays on record


def test_jobs_of_other_runs_are_left_out(spark, tmp_path):
    made = journal(spark, tmp_path)
    made.run(jobs(5), lambda job: {"score": 0.0})
    rows = made.run(jobs(2), lambda job: {"score": 9.0})
    assert sorted((r["trial"], r["score"]) for r in rows.collect()) == [(0, 0.0), (1, 0.0)]


def test_two_results_of_one_journal_together(spark, tmp_path):
    """Rows returned before and after the folder grew can stand in one plan."""
    made = journal(spark, tmp_path)
    first = made.run(jobs(3), lambda job: {"score": 0.0})
    more = made.run([{"stage": "two", "trial": 0}], lambda job: {"score": 1.0})
    assert first.unionByName(more).count() == 4


def test_odd_values(spark, tmp_path):
    made = journal(spark, tmp_path)
    made.record({"stage": 'a "quoted"\n/\\ name', "trial": -1, "score": float("nan"), "status": "ok"})
    made.record({"stage": "b", "trial": 2**62, "score": float("inf"), "status": "ok"})
    rows = {r["stage"]: r for r in made.rows().collect()}
    assert rows['a "quoted"\n/\\ name']["score"] is None and rows["b"]["trial"] == 2**62 and rows["b"]["score"] == float("inf")
    with pytest.raises(ValueError):
        made.record({"stage": "c", "trial": 1, "status": "ok", "unknown": 1})
    with pytest.raises(ValueError):
        Journal(spark, str(tmp_path / "x"), ["trial"], "trial long")
