"""Intermediate tables in the folder every executor can reach."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Folders made here, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint directory. Where none is set on a local master, as in
    tests, one folder is made per application and removed when Python ends; a cluster
    without one is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _OWN:
        _OWN[application] = folder = tempfile.mkdtemp(prefix="barspan-")
        maker = os.getpid()  # a forked Python worker that ends removes nothing
        atexit.register(lambda: shutil.rmtree(folder, ignore_errors=True) if os.getpid() == maker else None)
    return _OWN[application]


def run_folder(spark: SparkSession) -> str:
    """All intermediate tables of one application lie in one folder."""
    return f"{shared_folder(spark).rstrip('/')}/barspan-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Spark's setting that drops the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_DROPPING: dict[str, tuple[int, str | None]] = {}
_LOCK = threading.Lock()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What frames made inside shuffle is deleted when their execution ends.

    Otherwise the files lie on the executors' disks until the driver happens to collect its garbage, and those of
    all steps and passes add up. For frames that are executed once; another execution would shuffle again.
    """
    application = spark.sparkContext.applicationId
    with _LOCK:
        inside, before = _DROPPING.get(application) or (0, spark.conf.get(CLEANUP, None))
        _DROPPING[application] = inside + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            inside, before = _DROPPING.pop(application)
            if inside > 1:
                _DROPPING[application] = inside - 1, before
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and continue from the table.

    A frame joined with its own aggregates appears twice in the plan, and a chain
    of such joins doubles the work each time. Reading a table instead keeps the
    plan linear, and a lost executor repeats one step, not the whole lineage.
    """
    return written_at(df, name)[1]


def written_at(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """The folder of the written table, too, for a step that removes it when it is done."""
    path = fresh_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def only_scanned(df: DataFrame) -> bool:
    """Whether the frame reads one table and neither joins, sorts nor aggregates: reading it again costs no more."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName().startswith("Relation") or plan.nodeName() == "LogicalRelation"


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_tables(spark: SparkSession) -> None:
    """Delete every intermediate table of this application, once its results are consumed."""
    remove_table(spark, run_folder(spark))
