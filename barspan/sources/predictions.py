"""Prediction tables: out-of-fold rows, scored rows and resumable job lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barspan.functions.scalars import KEYS

OOF_COLUMNS = ["fold_id", *KEYS, "fret12", "pred"]


def average_duplicates(parts: list[DataFrame]) -> DataFrame:
    """Stack prediction tables and average rows that repeat a key."""
    if not parts:
        raise FileNotFoundError("no prediction tables")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(*KEYS).agg(F.avg("pred").alias("pred"), F.max("label").alias("label"))


def pending_jobs(jobs: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without an ``ok`` result; failed ones run again."""
    done = results.where(F.col("status") == "ok").select(*keys).distinct()
    return jobs.join(done, keys, "left_anti")


def append_oof(rows: DataFrame, root: str, run_id: str) -> None:
    """Append out-of-fold rows; one directory per run, profile and experiment."""
    columns = ["profile", "experiment_id", *OOF_COLUMNS]
    rows = rows.withColumn("run_id", F.lit(run_id)).select("run_id", *columns)
    clustered = rows.repartition("profile", "experiment_id", "fold_id")  # one file per fold of a member
    clustered.write.mode("append").partitionBy("run_id", "profile", "experiment_id").parquet(root)


def load_member(spark: SparkSession, root: str, run_id: str, profile: str, experiment_id: str) -> DataFrame:
    """Out-of-fold rows of one member, read from its own partition."""
    df = spark.read.parquet(root)
    missing = [c for c in OOF_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"{root} lacks {missing}")
    rows = df.where(
        (F.col("run_id") == run_id) & (F.col("profile") == profile) & (F.col("experiment_id") == experiment_id)
    ).select(*OOF_COLUMNS)
    if rows.limit(1).count() == 0:
        raise FileNotFoundError(f"no out-of-fold rows of {run_id}:{experiment_id} in profile {profile}")
    return rows


def dump_scored(rows: DataFrame, path: str) -> None:
    """Write keys, label and prediction of scored rows, partitioned by date."""
    rows.select(*KEYS, "label", "pred").repartition("date").write.mode("overwrite").partitionBy("date").parquet(path)
