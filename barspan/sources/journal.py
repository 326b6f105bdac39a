"""A journal of jobs: one small file for each finished job, so jobs may finish at the same time.

A row is written under a name that readers skip and then renamed to its job's name, which is a hash of the job's
key. A rename is one step of the file system: a reader finds the whole row or none, whatever else is written
to the folder, and no job shares a commit with another. A job that is run twice, by a retry or by a
second driver, ends as one file. A failed job's row is kept under its own name until the job succeeds; it
is run again by the next run.

Rows are as many as jobs (a few thousand at most); the work on data happens in the Spark jobs that a job starts.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

OK, ERROR = "ok", "error"


class BrokenOff(RuntimeError):
    """A run reached the number of jobs it was given; those that finished are in the journal."""


def _plain(value):
    """The value as JSON has it; numpy numbers become Python's."""
    value = value.item() if hasattr(value, "item") else value
    return None if isinstance(value, float) and math.isnan(value) else value


class Journal:
    """Results of jobs under ``root``. ``key``: the columns that name a job; ``schema``: of a row, with ``status``."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], schema: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.schema = StructType.fromDDL(schema)
        lacking = [c for c in (*key, "status") if c not in self.schema.names]
        if lacking:
            raise ValueError(f"a journal row lacks {lacking}")

    # -- files --------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _store(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def name(self, row: dict) -> str:
        """The file of a job: its key's hash and how it ended."""
        key = json.dumps([_plain(row[k]) for k in self.key], sort_keys=True)
        return f"{hashlib.sha256(key.encode()).hexdigest()[:32]}-{row['status']}.json"

    def record(self, row: dict) -> None:
        """Write one row. Of two attempts that end alike, one stays; nothing is half written."""
        unknown = sorted(set(row) - set(self.schema.names))
        if unknown:
            raise ValueError(f"a journal row has unknown columns {unknown}")
        text = json.dumps({k: _plain(v) for k, v in row.items() if v is not None}) + "\n"
        store, final, attempt = self._store(), self._path(self.name(row)), self._path(f"_attempt-{uuid.uuid4().hex}")
        out = store.create(attempt, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if row["status"] != OK and store.exists(final):
            store.delete(final, False)  # the latest failure tells most
        if not store.rename(attempt, final):
            store.delete(attempt, False)
            if not store.exists(final):
                raise OSError(f"{final} can't be written")

    def clear_attempts(self) -> int:
        """Delete what attempts that were broken off left behind; only while no run is under way."""
        store, gone = self._store(), 0
        if store.exists(self._path("")):
            for file in store.listStatus(self._path("")):
                if file.getPath().getName().startswith("_attempt-"):
                    gone += bool(store.delete(file.getPath(), False))
        return gone

    # -- rows ---------------------------------------------------------------------

    def all_rows(self) -> DataFrame:
        """Every row; a job that failed and then succeeded has two."""
        store, folder = self._store(), self._path("")
        files = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
        if not any(n.endswith(".json") and n[0] not in "._" for n in files):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).json(self.root)

    def rows(self) -> DataFrame:
        """One row for each job: its success, else its last failure. The fold is a partial aggregation."""
        whole = F.struct(*[F.col(c) for c in self.schema.names])
        rank = F.when(F.col("status") == OK, 1).otherwise(0)
        best = self.all_rows().groupBy(*[F.col(k).alias(f"_{k}") for k in self.key]).agg(F.max_by(whole, rank).alias("row"))
        return best.select("row.*")

    def finished(self) -> set[tuple]:
        """Keys of the jobs that succeeded."""
        return {tuple(r) for r in self.all_rows().where(F.col("status") == OK).select(*self.key).distinct().collect()}

    # -- runs ---------------------------------------------------------------------

    def run(self, jobs: Iterable[dict], work: Callable[[dict], dict], workers: int = 1, most: int | None = None) -> DataFrame:
        """Work off the jobs that haven't succeeded, ``workers`` at a time, and return the rows of all of them.

        ``work`` gets a job (its key and whatever else it holds) and returns the rest of its row; an exception
        makes a row with status ``error`` and the other jobs go on. After ``most`` jobs the run breaks off.
        """
        jobs, done = list(jobs), self.finished()
        key = lambda job: tuple(job[k] for k in self.key)
        waiting = [j for j in jobs if key(j) not in done]
        started = waiting if most is None else waiting[:most]

        def attempt(job: dict) -> None:
            row, began = {k: job[k] for k in self.key}, time.time()
            try:
                row = {"status": OK} | row | work(job)
            except Exception as error:
                row |= {"status": ERROR} | ({"error_msg": str(error)[:2000]} if "error_msg" in self.schema.names else {})
            if "runtime_sec" in self.schema.names:
                row.setdefault("runtime_sec", time.time() - began)
            self.record(row)

        with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
            list(pool.map(attempt, started))
        if len(started) < len(waiting):
            raise BrokenOff(f"{len(waiting) - len(started)} of {len(jobs)} jobs are left")
        # A snapshot: Spark takes two listings of one folder for the same table, however much the folder has grown.
        wanted = {key(j) for j in jobs}
        return self.spark.createDataFrame([r for r in self.rows().collect() if tuple(r[k] for k in self.key) in wanted], self.schema)
