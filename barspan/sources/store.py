"""Feature store: one parquet table per stage, partitioned by date, and a manifest."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from barspan.functions.scalars import KEYS, LABEL, clean
from barspan.plans.catalogue import CATALOGUE, Catalogue, date_steps
from barspan.plans.digests import compared
from barspan.plans.tables import shuffles_dropped
from barspan.sources.bars import Panel

DTYPES = ("float32", "float64", None)
MANIFEST_SCHEMA = (
    "common_version string, stage string, code_hash string, built_at timestamp, n_days bigint, columns array<string>"
)


#: Rows of a date that one file of a stage holds.
FILE_ROWS = 500_000


@dataclass(frozen=True)
class Staleness:
    """Why a stage is rebuilt: a code, what the manifest holds, what is wanted, and a name or number with it."""

    code: str  # forced, version, unrecorded, code, days or upstream
    recorded: str | None = None
    wanted: str | None = None
    detail: str | int | None = None

    def __str__(self) -> str:
        values = [("recorded", self.recorded), ("wanted", self.wanted), ("detail", self.detail)]
        return " ".join([self.code, *[f"{k}={v}" for k, v in values if v is not None]])


class FeatureStore:
    def __init__(self, panel: Panel, root: str, catalogue: Catalogue = CATALOGUE, version: str = "1"):
        self.panel, self.root, self.catalogue, self.version = panel, root.rstrip("/"), catalogue, version
        self.spark = panel.spark

    def path(self, stage: str) -> str:
        return f"{self.root}/{stage}"

    # -- manifest ---------------------------------------------------------------

    def manifest(self) -> dict[str, dict]:
        """stage -> its manifest row; one row per stage, so reading it here is safe."""
        try:
            rows = self.spark.read.schema(MANIFEST_SCHEMA).json(f"{self.root}/_manifest").collect()
        except AnalysisException:
            return {}
        latest = {}
        for row in sorted(rows, key=lambda r: r["built_at"]):
            latest[row["stage"]] = row.asDict()
        return latest

    def _record(self, stages: list[str], n_days: dict[str, int]) -> None:
        rows = [
            (self.version, s, self.catalogue.code_hash(s), n_days[s], self.catalogue.stages[s].columns) for s in stages
        ]
        frame = self.spark.createDataFrame(
            rows, "common_version string, stage string, code_hash string, n_days bigint, columns array<string>"
        )
        frame.withColumn("built_at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{self.root}/_manifest")

    # -- state ------------------------------------------------------------------

    def built_days(self, stage: str) -> DataFrame:
        """Dates of a stage, from its partition names alone."""
        try:
            return self.spark.read.parquet(self.path(stage)).select(F.col("date").cast("bigint").alias("date")).distinct()
        except AnalysisException:
            return self.spark.createDataFrame([], "date bigint")

    def wanted_days(self, dates: list[int] | None) -> DataFrame:
        days = self.panel.df.select("date").distinct()
        return days if dates is None else days.where(F.col("date").isin(dates))

    def selected(self, stages: list[str] | None) -> list[str]:
        """The chosen stages with everything downstream of them, in stage order."""
        if not stages:
            return self.catalogue.order()
        unknown = [s for s in stages if s not in self.catalogue.stages]
        if unknown:
            raise KeyError(f"unknown stages: {unknown}")
        chosen = set(stages).union(*[self.catalogue.downstream(s) for s in stages])
        return [s for s in self.catalogue.order() if s in chosen]

    def dirty(
        self, dates: list[int] | None = None, force: bool = False, stages: list[str] | None = None
    ) -> dict[str, Staleness]:
        """stage -> why it must be rebuilt. Each stage is judged by its own record."""
        manifest, wanted = self.manifest(), self.wanted_days(dates)
        out: dict[str, Staleness] = {}
        for s in self.selected(stages):
            stale = Staleness("forced") if force else self._stale(s, manifest.get(s), wanted)
            behind = next((n for n in self.catalogue.stages[s].needs if n in out), None)
            if stale is None and behind is not None:
                stale = Staleness("upstream", detail=behind)
            if stale is not None:
                out[s] = stale
        return out

    def _stale(self, stage: str, recorded: dict | None, wanted: DataFrame) -> Staleness | None:
        if recorded is None:
            return Staleness("unrecorded")
        if recorded["common_version"] != self.version:
            return Staleness("version", recorded["common_version"], self.version)
        code = self.catalogue.code_hash(stage)
        if recorded["code_hash"] != code:
            return Staleness("code", recorded["code_hash"], code)
        lacking = wanted.join(self.built_days(stage), "date", "left_anti").count()
        return Staleness("days", detail=lacking) if lacking else None

    def status(self, dates: list[int] | None = None) -> DataFrame:
        dirty, manifest = self.dirty(dates), self.manifest()
        rows = []
        for s in self.catalogue.order():
            recorded = manifest.get(s, {})
            rows.append(
                (
                    s,
                    "dirty" if s in dirty else "ok",
                    str(dirty.get(s, "")),
                    recorded.get("code_hash") or self.catalogue.code_hash(s),
                    int(recorded.get("n_days") or 0),
                    len(self.catalogue.stages[s].columns),
                )
            )
        return self.spark.createDataFrame(
            rows, "stage string, state string, reason string, code_hash string, n_days bigint, n_columns bigint"
        )

    # -- writing ----------------------------------------------------------------

    def build(
        self, dates: list[int] | None = None, force: bool = False, stages: list[str] | None = None
    ) -> dict[str, Staleness]:
        """Rebuild what is dirty. A stage that only lacks days gets those days;
        otherwise all wanted days are written. Returns the reasons."""
        dirty = self.dirty(dates, force, stages)
        wanted = self.wanted_days(dates)
        counts = {}
        for s in dirty:
            days = wanted
            if dirty[s].code == "days":
                days = wanted.join(self.built_days(s), "date", "left_anti")
            self.write_stage(s, days)
            counts[s] = self.built_days(s).count()
        if dirty:
            self._record(list(dirty), counts)
        return dirty

    def write_stage(self, stage: str, days: DataFrame) -> None:
        """Overwrite only the partitions of the given days. The stage is computed
        from raw bars with its upstream columns in the same plan, so it reads
        the bars once and joins nothing. A date's rows meet in as many tasks
        as it needs files, not in one file per task and date. A large panel is
        written some dates after the other; what a step shuffles is gone before the next."""
        with shuffles_dropped(self.spark):
            for dates, rows in date_steps(self.panel, days):
                own = days if dates is None else days.where(F.col("date").isin([d for d in dates if d is not None]))
                (
                    by_date(self.computed(stage, own, rows), self.panel.layout.date_rows)
                    .write.mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic")
                    .partitionBy("date")
                    .parquet(self.path(stage))
                )

    def computed(self, stage: str, days: DataFrame, rows: int | None = None) -> DataFrame:
        """Rows of a stage from raw bars, at the precision a store keeps; ``rows`` says how many bars the days have."""
        bars = self.panel.df.join(days, "date", "left_semi")
        part = self.panel.with_df(bars)
        if rows is not None:
            part = replace(part, layout=replace(part.layout, total_rows=rows))
        frame = self.catalogue.with_stages(part, [stage])
        return frame.select(*KEYS, *[F.col(c).cast("float").alias(c) for c in self.catalogue.stages[stage].columns])

    # -- reading ----------------------------------------------------------------

    def read_stage(self, stage: str, where: Column | None = None) -> DataFrame:
        """Rows of a stage; ``where`` filters dates and prunes partitions."""
        df = self.spark.read.parquet(self.path(stage))
        df = df if where is None else df.where(where)
        return df.withColumn("date", F.col("date").cast("bigint"))

    def load(
        self, dates: list[int] | None = None, groups: list[str] | None = None, dtype: str | None = "float32"
    ) -> DataFrame:
        return self._load(None if dates is None else F.col("date").isin(dates), groups, dtype)

    def load_range(
        self, start: int, end: int, groups: list[str] | None = None, dtype: str | None = "float64"
    ) -> DataFrame:
        return self._load(F.col("date").between(start, end), groups, dtype)

    def _load(self, where: Column | None, groups: list[str] | None, dtype: str | None) -> DataFrame:
        """Keys, label and the columns of the groups, stages joined on the keys.
        A column two stages share comes from the first of them."""
        if dtype not in DTYPES:
            raise ValueError(f"dtype must be one of {DTYPES}")
        resolved = self.catalogue.resolve(groups)
        bars = self.panel.df if where is None else self.panel.df.where(where)
        out = bars.select(*KEYS, clean(F.col(LABEL)).alias(LABEL))
        seen: set[str] = set()
        for s in [n for n in self.catalogue.order() if n in resolved]:
            columns = [c for c in resolved[s] if c not in seen]
            seen.update(columns)
            out = out.join(self.read_stage(s, where).select(*KEYS, *columns), KEYS)
        if dtype is None:
            return out
        kind = {"float32": "float", "float64": "double"}[dtype]
        return out.select(*KEYS, LABEL, *[F.col(c).cast(kind).alias(c) for c in self.catalogue.columns(groups)])

    def misaligned(self, stage: str) -> DataFrame:
        """Bars without a stage row and stage rows without a bar: both must be 0."""
        raw, built = self.panel.df.select(*KEYS), self.read_stage(stage).select(*KEYS)
        missing = raw.join(built, KEYS, "left_anti").select(F.lit("missing").alias("kind"))
        extra = built.join(raw, KEYS, "left_anti").select(F.lit("extra").alias("kind"))
        both = missing.unionByName(extra)
        return both.agg(
            F.count(F.when(F.col("kind") == "missing", 1)).alias("n_missing"),
            F.count(F.when(F.col("kind") == "extra", 1)).alias("n_extra"),
        )

    def verify(self, stage: str, dates: list[int] | None = None) -> DataFrame:
        """Per date: rows stored and rows the bars give today, and whether they are the same in every column.

        Both sides shrink to one digest per date before they meet; no row is joined.
        """
        days = self.wanted_days(dates)
        stored = self.read_stage(stage).join(days, "date", "left_semi")
        columns = [*KEYS[1:], *self.catalogue.stages[stage].columns]
        out = compared(stored, self.computed(stage, days), ["date"], columns)
        return out.withColumnsRenamed({"n_left": "n_stored", "n_right": "n_wanted"})

    def check_alignment(self, stage: str) -> None:
        row = self.misaligned(stage).first()
        if row["n_missing"] or row["n_extra"]:
            raise ValueError(f"stage {stage}: {row['n_missing']} bars missing, {row['n_extra']} rows without a bar")


def by_date(df: DataFrame, date_rows: int) -> DataFrame:
    """Rows dealt by date, a date of ``date_rows`` to one task per FILE_ROWS of it."""
    files = -(-max(1, date_rows) // FILE_ROWS)
    if files == 1:
        return df.repartition("date")
    return df.repartition("date", F.pmod(F.xxhash64("symbol", "bar"), F.lit(files)))


# -- run artefacts ----------------------------------------------------------------


def save_run(root: str, run_id: str, tables: dict[str, DataFrame], config: dict | None = None) -> None:
    """One table per artefact, keyed by the run id."""
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("run_id").parquet(f"{root}/{name}")
    if config is not None and tables:
        spark = next(iter(tables.values())).sparkSession
        frame = spark.createDataFrame([(run_id, json.dumps(config, sort_keys=True))], "run_id string, config string")
        frame.coalesce(1).write.mode("append").json(f"{root}/config")
