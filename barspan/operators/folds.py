"""Walk-forward folds cut from a trading calendar."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F



@dataclass(frozen=True)
class Profile:
    name: str
    val_days: int
    step: int
    embargo: int = 1
    mode: str = "sliding"
    train_days: int | None = None
    min_train_days: int = 10


# The standard profiles and their weights in the protocol score.
PROFILES = [
    Profile("short_8d_2d", val_days=2, step=5, train_days=8, min_train_days=8),
    Profile("medium_20d_5d", val_days=5, step=5, train_days=20, min_train_days=20),
    Profile("long_40d_5d", val_days=5, step=10, train_days=40, min_train_days=40),
    Profile("expanding_40d_5d", val_days=5, step=5, mode="expanding", min_train_days=40),
]
PROFILE_WEIGHTS = {
    "short_8d_2d": 0.25,
    "medium_20d_5d": 0.35,
    "long_40d_5d": 0.25,
    "expanding_40d_5d": 0.15,
}
EARLY_STOP_SHARE = 0.15
MIN_CORE_DAYS = 10


def _calendar_row(calendar: DataFrame) -> DataFrame:
    """The whole calendar in one row; folds are slices of it."""
    row = calendar.agg(F.sort_array(F.collect_list("day")).alias("days"))
    return row.withColumn("n", F.size("days"))


def _cursors(first: Column | int, last: Column, step: int) -> Column:
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )


def _part(start: Column, end: Column) -> Column:
    """Days of the half-open position range [start, end)."""
    return F.slice("days", start + F.lit(1), F.greatest(end - start, F.lit(0)))


def _split(rows: DataFrame, profile: Profile) -> DataFrame:
    """fold_id, train, embargo and val day arrays for each cursor of a profile."""
    cursor, embargo = F.col("cursor"), max(0, profile.embargo)
    if profile.mode == "sliding":
        if profile.train_days is None:
            raise ValueError("a sliding profile needs train_days")
        first = profile.train_days + embargo
        val_start = cursor
        train_start = F.greatest(cursor - F.lit(embargo + profile.train_days), F.lit(0))
        last = F.col("n") - F.lit(profile.val_days)
    elif profile.mode == "expanding":
        first = profile.min_train_days
        val_start = cursor + F.lit(embargo)
        train_start = F.lit(0)
        last = F.col("n") - F.lit(embargo + profile.val_days)
    else:
        raise ValueError(f"unknown mode {profile.mode!r}")
    cut = rows.select("days", "n", F.posexplode(_cursors(first, last, profile.step)).alias("at", "cursor"))
    cut = cut.select(
        F.lit(profile.name).alias("profile"),
        "at",
        "days",
        "n",
        _part(train_start, val_start - F.lit(embargo)).alias("train"),
        _part(val_start - F.lit(embargo), val_start).alias("embargo"),
        _part(val_start, val_start + F.lit(profile.val_days)).alias("val"),
    )
    # A window shorter than the minimum is skipped. Lengths do not depend on the
    # cursor (sliding) or never fall below it (expanding): all or none qualify.
    enough = (F.size("train") >= profile.min_train_days) & (F.size("val") > 0)
    return cut.where(enough).withColumnRenamed("at", "fold_id")


def fold_splits(calendar: DataFrame, profile: Profile, max_folds: int | None = None) -> DataFrame:
    cut = _split(_calendar_row(calendar), profile)
    return cut if max_folds is None else cut.where(F.col("fold_id") < max_folds)


def fold_table(calendar: DataFrame, profile: Profile, max_folds: int | None = None) -> DataFrame:
    """One row per fold with the first and last day of each segment."""
    cut = fold_splits(calendar, profile, max_folds)
    first, last = (lambda c: F.element_at(c, 1)), (lambda c: F.element_at(c, -1))
    held = F.size("embargo") > 0
    return cut.select(
        "profile",
        F.col("fold_id").cast("bigint").alias("fold_id"),
        first("train").alias("train_start"),
        last("train").alias("train_end"),
        F.when(held, F.get("embargo", F.lit(0))).otherwise(last("train")).alias("embargo_start"),
        F.when(held, F.get("embargo", F.size("embargo") - 1)).otherwise(last("train")).alias("embargo_end"),
        first("val").alias("val_start"),
        last("val").alias("val_end"),
        F.size("train").cast("bigint").alias("n_train_days"),
        F.size("val").cast("bigint").alias("n_val_days"),
    )


def simple_folds(
    calendar: DataFrame, train_days: int, val_days: int, step: int, min_train_days: int = 30, embargo: int = 0
) -> DataFrame:
    """Rolling folds; without a single fold and with at least 3 days, the last
    max(1, min(2, n / 3)) days validate against all the others."""
    profile = Profile("rolling", val_days, step, embargo, "sliding", train_days, min_train_days)
    row = _calendar_row(calendar)
    regular = _split(row, profile).select("fold_id", "train", "val")
    n = F.col("n")
    held = F.greatest(F.lit(1), F.least(F.lit(2), F.floor(n / F.lit(3)).cast("int")))
    any_regular = regular.agg(F.count(F.lit(1)).alias("c")).select("c").scalar()
    fallback = row.where((n >= 3) & (any_regular == 0)).select(
        F.lit(0).alias("fold_id"), _part(F.lit(0), n - held).alias("train"), _part(n - held, n).alias("val")
    )
    both = regular.unionByName(fallback)
    return both.select(
        F.col("fold_id").cast("bigint").alias("fold_id"),
        F.element_at("train", 1).alias("train_start"),
        F.element_at("train", -1).alias("train_end"),
        F.element_at("val", 1).alias("val_start"),
        F.element_at("val", -1).alias("val_end"),
        F.size("train").cast("bigint").alias("n_train_days"),
        F.size("val").cast("bigint").alias("n_val_days"),
    )


def recent_splits(
    calendar: DataFrame, val_days: int, step: int, embargo: int, min_train_days: int, max_folds: int
) -> DataFrame:
    """Scoring blocks laid backwards from the last day, training from the first."""
    back = step if step > 0 else val_days
    row = _calendar_row(calendar).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(max_folds - 1))))
    high = F.col("n") - F.col("k") * F.lit(back)
    low = high - F.lit(val_days)
    kept = row.where((low >= 0) & (low - F.lit(embargo) >= min_train_days))
    count = kept.agg(F.count(F.lit(1)).alias("c")).select("c").scalar()
    return kept.select(
        (count - F.lit(1) - F.col("k")).cast("bigint").alias("fold_id"),
        "days",
        "n",
        _part(F.lit(0), low - F.lit(embargo)).alias("train"),
        _part(low, high).alias("val"),
    )


def early_stop_days(n: Column, share: float, at_least: int = 1, core: int = MIN_CORE_DAYS) -> Column:
    """Length of the early-stopping tail: half-even rounding, core days first."""
    tail = F.greatest(F.lit(at_least), F.rint(n.cast("double") * F.lit(share)).cast("int"))
    return F.greatest(F.least(tail, F.greatest(F.lit(0), n - F.lit(core))), F.lit(0))


SEGMENTS = ["train_core", "earlystop", "embargo", "scoring"]


def _tagged(segment: str) -> Column:
    """Days of a segment as (day, segment) pairs."""
    return F.transform(segment, lambda d: F.struct(d.alias("day"), F.lit(segment).alias("segment")))


def segment_days(splits: DataFrame, embargo: int, share: float = EARLY_STOP_SHARE) -> DataFrame:
    """fold_id, day, segment of four-segment folds, from train and val arrays."""
    size = F.size("train")
    tail = early_stop_days(size, share)
    end = F.array_position("days", F.element_at("train", -1)).cast("int")
    parts = splits.select(
        F.col("fold_id").cast("bigint").alias("fold_id"),
        F.slice("train", F.lit(1), size - tail).alias("train_core"),
        F.slice("train", size - tail + F.lit(1), tail).alias("earlystop"),
        F.slice("days", end + F.lit(1), F.lit(embargo)).alias("embargo"),
        F.col("val").alias("scoring"),
    )
    tagged = F.concat(*[_tagged(s) for s in SEGMENTS])
    return parts.select("fold_id", F.explode(tagged).alias("d")).select("fold_id", "d.day", "d.segment")


def four_segment_folds(
    calendar: DataFrame,
    profile: Profile,
    select: str = "first",
    max_folds: int | None = None,
    share: float = EARLY_STOP_SHARE,
) -> DataFrame:
    embargo = max(0, profile.embargo)
    if select == "recent" and max_folds is not None:
        splits = recent_splits(
            calendar, profile.val_days, profile.step, embargo, profile.min_train_days, max_folds
        )
    else:
        splits = fold_splits(calendar, profile, max_folds)
    return segment_days(splits, embargo, share)


def delivery_fold(
    calendar: DataFrame, train_end: int, eval_end: int, embargo: int = 1, fold_id: int = 0
) -> DataFrame:
    """Train to a date, hold the embargo, score everything up to ``eval_end``."""
    row = _calendar_row(calendar.where(F.col("day") <= eval_end))
    cut = F.size(F.filter("days", lambda d: d <= F.lit(train_end)))
    splits = row.select(
        F.lit(fold_id).alias("fold_id"),
        "days",
        _part(F.lit(0), cut).alias("train"),
        _part(cut + F.lit(max(0, embargo)), F.col("n")).alias("val"),
    )
    return segment_days(splits, max(0, embargo))


def causality_violations(fold_days: DataFrame) -> DataFrame:
    """Pairs of segments of a fold that are not strictly ordered; must be empty."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(SEGMENTS) for x in (s, i)])
    spans = fold_days.groupBy("fold_id", "segment").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )
    spans = spans.withColumn("at", order[F.col("segment")])
    a, b = spans.alias("a"), spans.alias("b")
    pairs = a.join(b, (F.col("a.fold_id") == F.col("b.fold_id")) & (F.col("a.at") < F.col("b.at")))
    return pairs.where(F.col("a.last_day") >= F.col("b.first_day")).select(
        "a.fold_id", F.col("a.segment").alias("earlier"), F.col("b.segment").alias("later")
    )


def assert_causal(fold_days: DataFrame) -> None:
    bad = causality_violations(fold_days).take(1)
    if bad:
        raise AssertionError(f"fold {bad[0]['fold_id']}: {bad[0]['earlier']} is not before {bad[0]['later']}")


def fold_days(calendar: DataFrame, profiles: list[Profile]) -> DataFrame:
    """profile, fold_id, day, segment (train or val) for every profile."""
    parts = []
    for profile in profiles:
        cut = fold_splits(calendar, profile)
        tagged = F.concat(_tagged("train"), _tagged("val"))
        parts.append(
            cut.select("profile", F.col("fold_id").cast("bigint").alias("fold_id"), F.explode(tagged).alias("d"))
            .select("profile", "fold_id", F.col("d.day").alias("date"), "d.segment")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def attach_folds(bars: DataFrame, days: DataFrame) -> DataFrame:
    """Bars repeated for every fold that uses their date.

    An equi join on the date: the fold table has one row per fold and day, so it
    is broadcast while Spark measures it small and shuffled beyond that.
    """
    return bars.join(days, "date")


def date_range(bars: DataFrame, start: int, end: int) -> DataFrame:
    return bars.where(F.col("date").between(start, end))


def holdout(bars: DataFrame, train: tuple[int, int], held: tuple[int, int], name: str) -> DataFrame:
    """Rows of a fixed train / holdout split, tagged with their segment."""
    inside = lambda r: F.col("date").between(*r)
    segment = F.when(inside(train), F.lit("train")).when(inside(held), F.lit("holdout"))
    return bars.withColumns({"holdout_name": F.lit(name), "segment": segment}).where(
        F.col("segment").isNotNull()
    )


