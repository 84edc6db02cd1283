"""Fingerprints kept up to date from the days that changed.

Beside the fingerprints lie the daily partials they are made from. A change of
the catalogue (rows added, revised or deleted) names the days that its rows lie
on, before and after. The partials of those days are made anew from the
catalogue, so nothing is ever subtracted from a floating sum; then come the
windows that hold such a day, and the percentiles of everything later in the
same series. Only the partitions with such rows are written.

Columns of a whole epoch (threshold, completeness, number of events) change with
any of its events; they are kept once per group and joined when the table is
read. A threshold that moves makes its group anew, and no other.

An update only reads the catalogue as it is now, so one that broke off is simply
run again with the same days.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.operators.epochs import thresholds_of_counts
from quakeloom.operators.fingerprints import (
    GID, GROUP, MAGNITUDE, POPULATION, WINDOW, add_percentiles, daily_histograms, daily_sums, day_limits, days_since,
    feature_columns, last_strong, populations, spread_days, windows_of_days, with_comparable,
)
from quakeloom.session import staged

SUMS, HISTOGRAMS, GROUPS, GOLD = "sums", "histograms", "groups", "fingerprints"
SERIES = [*POPULATION, "tectonic_domain"]
ROW = [*SERIES, "comparison_epoch", "window_days", "window_end"]
#: Columns of a whole group, which are not stored with its rows.
OF_GROUP = {
    "comparison_epoch_label": "epoch_label",
    "comparison_magnitude_threshold": "comparison_threshold",
    "epoch_catalogue_mc": "estimated_mc",
    "epoch_event_count": "epoch_event_count",
}


@dataclass(frozen=True)
class Settings:
    window_days: tuple[int, ...] = (30, 90, 365)
    step_days: int = 7
    minimum_window_events: int = 1
    minimum_reference_windows: int = 10
    modes: tuple[str, ...] = ("complete",)
    policies: tuple[str, ...] = ("operational",)


def changed_days(*versions: DataFrame) -> DataFrame:
    """Days of the rows that changed: of those added, those deleted, and of both versions of those revised."""
    days = [
        v.filter("origin_time_utc is not null").select(F.unix_date(F.to_date("origin_time_utc")).alias("day")) for v in versions
    ]
    found = days[0]
    for more in days[1:]:
        found = found.unionByName(more)
    return found.distinct()


def build(catalogue: DataFrame, root: str, settings: Settings = Settings()) -> None:
    """Partials and fingerprints of the whole catalogue under ``root``."""
    spark = catalogue.sparkSession
    members = populations(catalogue, settings.modes, settings.policies)
    counts = members.groupBy(*GROUP, "magnitude_comparable").agg(F.count(F.lit(1)).alias("n"))
    groups = _numbered(staged(thresholds_of_counts(counts, GROUP)))
    events = with_comparable(members, groups)
    _write(staged(_by_year(daily_sums(events))), f"{root}/{SUMS}", ["year"])
    _write(staged(_by_year(daily_histograms(events))), f"{root}/{HISTOGRAMS}", ["year"])
    groups.write.mode("overwrite").parquet(f"{root}/{GROUPS}")
    daily, histograms = _read(spark, root, SUMS), _read(spark, root, HISTOGRAMS)
    anchors = staged(day_limits(daily))
    windows = windows_of_days(
        daily, histograms, anchors, settings.window_days, settings.step_days, settings.minimum_window_events
    )
    features = staged(feature_columns(windows.join(last_strong(daily, windows), WINDOW, "left").join(groups, GID)))
    made = add_percentiles(features, settings.step_days, settings.minimum_reference_windows)
    _write(_stored(made), f"{root}/{GOLD}", [*POPULATION, "year"])


def load(spark: SparkSession, root: str) -> DataFrame:
    """The fingerprints under ``root``, with the columns of ``build_fingerprints``."""
    groups = _read(spark, root, GROUPS).select(
        *SERIES, F.col("observation_epoch").alias("comparison_epoch"), *[F.col(c).alias(n) for n, c in OF_GROUP.items()]
    )
    return _read(spark, root, GOLD).drop("year").join(groups, [*SERIES, "comparison_epoch"])


def update(catalogue: DataFrame, root: str, changed: DataFrame, settings: Settings = Settings()) -> None:
    """Bring ``root`` up to date with ``catalogue``, which differs from what it was made from
    on the days of ``changed`` (day) only. ``settings`` must be those of ``build``."""
    spark = catalogue.sparkSession
    days = staged(changed.select("day").distinct())
    if days.isEmpty():
        return
    old_sums, old_histograms = _read(spark, root, SUMS), _read(spark, root, HISTOGRAMS)
    old_groups = staged(_read(spark, root, GROUPS))
    old_anchors = staged(day_limits(old_sums))
    dated = catalogue.withColumn("_day", F.unix_date(F.to_date("origin_time_utc")))

    def members(frame: DataFrame) -> DataFrame:
        return populations(frame, settings.modes, settings.policies)

    # Thresholds: what the other days count, from the partials, and the changed days counted anew.
    fresh = staged(members(dated.join(days.withColumnRenamed("day", "_day"), "_day", "left_semi").drop("_day")))
    groups = _numbered(staged(thresholds_of_counts(_counts(old_sums, old_histograms, old_groups, days, fresh), GROUP)))
    moved = staged(_moved(old_groups, groups))
    if not moved.isEmpty():
        rest = members(dated.join(days.withColumnRenamed("day", "_day"), "_day", "left_anti").drop("_day"))
        fresh = fresh.unionByName(rest.join(moved.select(*GROUP), GROUP, "left_semi"))
    events = with_comparable(fresh, groups)

    # Partials: the others stay; a year with a change is written anew.
    def renewed(old: DataFrame, new: DataFrame) -> DataFrame:
        return staged(_by_year(_others(old, days, moved).unionByName(new.select(*[c for c in old.columns if c != "year"]))))

    touched = staged(
        old_sums.select(GID, "day").join(days, "day", "left_semi")
        .unionByName(old_sums.select(GID, "day").join(moved.select(GID), GID, "left_semi"))
        .unionByName(events.select(GID, "day"))
        .distinct()
    )
    years = [r["year"] for r in touched.select(_year("day").alias("year")).distinct().collect()]
    for name, old, new in ((SUMS, old_sums, daily_sums(events)), (HISTOGRAMS, old_histograms, daily_histograms(events))):
        _replace(renewed(old.filter(F.col("year").isin(years)), new), f"{root}/{name}", ["year"], old.filter(F.col("year").isin(years)))
    groups.write.mode("overwrite").parquet(f"{root}/{GROUPS}")
    _update_gold(spark, root, groups, moved, old_groups, old_anchors, touched, settings)


def _update_gold(
    spark: SparkSession, root: str, groups: DataFrame, moved: DataFrame, old_groups: DataFrame, old_anchors: DataFrame,
    touched: DataFrame, settings: Settings,
) -> None:
    daily, histograms = _read(spark, root, SUMS), _read(spark, root, HISTOGRAMS)
    anchors = staged(day_limits(daily))
    begins = staged(_first_changes(old_anchors, anchors, touched, moved))
    # Windows that hold a changed day; all from where the group's days now end; all, if its first day moved.
    affected = anchors.join(begins, GID)
    holding = spread_days(touched.join(affected, GID), settings.window_days, settings.step_days).select(*WINDOW)
    late = spread_days(
        daily.select(GID, "day").distinct().join(affected, GID).filter(F.col("day") >= F.col("_from") - max(settings.window_days)),
        settings.window_days, settings.step_days,
    ).filter(F.col("d0") + F.col("window_index") * settings.step_days + F.col("window_days") - 1 >= F.col("_open")).select(*WINDOW)
    only = staged(holding.unionByName(late).distinct())
    # Days that such windows can hold, so that other years of the partials are not read.
    limits = affected.agg(F.min("_from").alias("low")).first()
    low = (limits["low"] if limits["low"] is not None else 0) - max(settings.window_days)
    recent = _year(F.lit(low))

    def near(frame: DataFrame) -> DataFrame:
        return frame.filter(F.col("year") >= recent).drop("year").join(begins.select(GID), GID, "left_semi")

    windows = windows_of_days(
        near(daily), near(histograms), anchors, settings.window_days, settings.step_days, settings.minimum_window_events, only
    )
    strong = daily.join(begins.select(GID), GID, "left_semi")
    made = staged(feature_columns(windows.join(last_strong(strong, windows), WINDOW, "left").join(groups, GID)))

    # A series is changed from the first change of any of its groups on.
    every = old_groups.select(GID, *GROUP).unionByName(groups.select(GID, *GROUP)).distinct()
    series = staged(every.join(begins, GID).groupBy(*SERIES).agg(F.min("_from").alias("_from")))
    gold = _read(spark, root, GOLD)
    in_series = gold.join(series, SERIES)
    end_day = F.unix_date(F.to_date("window_end"))
    # Windows of the old table that stay as they are: of groups that still are, within their days, and not made anew.
    made_anew = only.join(anchors, GID).select(
        GID, "window_days", (F.col("d0") + F.col("window_index") * settings.step_days + F.col("window_days") - 1).alias("end_day")
    )
    numbered = in_series.withColumn("end_day", end_day).join(
        groups.select(GID, *SERIES, F.col("observation_epoch").alias("comparison_epoch")), [*SERIES, "comparison_epoch"]
    )
    kept = numbered.join(begins.select(GID, "_open"), GID, "left").filter("_open is null or end_day < _open").drop("_open")
    kept = kept.join(made_anew, [GID, "window_days", "end_day"], "left_anti")
    before, later = kept.filter("end_day < _from"), staged(kept.filter("end_day >= _from"))
    # The last strong event before a window can have changed although the window has not.
    asked = later.select(GID, "window_days", F.col("end_day").alias("window_index"), "end_day")
    since = last_strong(daily.join(asked.select(GID).distinct(), GID, "left_semi"), asked).withColumnRenamed("window_index", "end_day")
    again = later.join(since, [GID, "window_days", "end_day"], "left").withColumn(
        "days_since_previous_m3", days_since("end_day", "last_strong")
    )
    features = [c for c in made.columns if c not in OF_GROUP]
    changed = staged(again.select(*features).unionByName(made.select(*features)))
    # Percentiles need the counts of the whole series, and no other column of its unchanged part.
    counts = ["event_count", "comparable_event_count"]
    narrow = before.select(*ROW, *counts).unionByName(changed.select(*ROW, *counts))
    ranked = add_percentiles(narrow, settings.step_days, settings.minimum_reference_windows).drop(*counts)
    tail = (
        changed.join(ranked, ROW).withColumn("year", F.year("window_end"))
    )
    tail = staged(tail.select(*gold.columns))
    old_tail = in_series.filter(end_day >= F.col("_from"))
    partition = [*POPULATION, "year"]
    parts = staged(old_tail.select(*partition).unionByName(tail.select(*partition)).distinct())
    stays = gold.join(parts, partition, "left_semi").join(
        series.withColumnRenamed("_from", "_start"), SERIES, "left"
    ).filter(F.col("_start").isNull() | (end_day < F.col("_start"))).select(*gold.columns)
    _replace(staged(stays.unionByName(tail)), f"{root}/{GOLD}", partition, parts)


def _first_changes(old: DataFrame, new: DataFrame, touched: DataFrame, moved: DataFrame) -> DataFrame:
    """gid, the day from which its rows can change, and the day from which its windows can come or go."""
    both = (
        touched.groupBy(GID).agg(F.min("day").alias("first"))
        .join(moved.select(GID, F.lit(True).alias("all")), GID, "full")
        .join(old.select(GID, F.col("d0").alias("a0"), (F.col("d0") + F.col("span")).alias("a1")), GID, "left")
        .join(new.select(GID, F.col("d0").alias("b0"), (F.col("d0") + F.col("span")).alias("b1")), GID, "left")
    )
    start = F.least("a0", "b0")
    whole = F.coalesce("all", F.lit(False)) | ~F.col("a0").eqNullSafe(F.col("b0"))
    # Where the last day moved, windows come or go after the earlier one.
    ending = F.when(F.col("a1") != F.col("b1"), F.least("a1", "b1") + 1)
    return both.select(
        GID,
        F.when(whole, start).otherwise(F.least("first", ending)).alias("_from"),
        F.when(whole, start).otherwise(F.coalesce(ending, F.greatest("a1", "b1") + 1)).alias("_open"),
    )


def _numbered(thresholds: DataFrame) -> DataFrame:
    """A number for each group that is the same in every run. Two groups of one number would be an error."""
    numbered = thresholds.withColumn(GID, F.xxhash64(*GROUP))
    if not numbered.groupBy(GID).count().filter("count > 1").isEmpty():
        raise ArithmeticError("two groups have one number")
    return numbered


def _counts(sums: DataFrame, histograms: DataFrame, groups: DataFrame, days: DataFrame, fresh: DataFrame) -> DataFrame:
    names = groups.select(GID, *GROUP)
    known = histograms.filter(F.col("kind") == MAGNITUDE).join(days, "day", "left_anti").groupBy(
        GID, F.col("a").alias("magnitude_comparable")
    ).agg(F.sum("n").alias("n"))
    none = sums.join(days, "day", "left_anti").groupBy(GID).agg(F.sum(F.col("n") - F.col("n_mag")).alias("n")).filter("n > 0")
    old = known.unionByName(none.withColumn("magnitude_comparable", F.lit(None).cast("double"))).join(names, GID)
    new = fresh.groupBy(*GROUP, "magnitude_comparable").agg(F.count(F.lit(1)).alias("n"))
    columns = [*GROUP, "magnitude_comparable"]
    return old.select(*columns, "n").unionByName(new.select(*columns, "n")).groupBy(*columns).agg(F.sum("n").alias("n"))


def _moved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Groups whose threshold is another one, and groups that came or went."""
    limit = "comparison_threshold"
    both = old.select(GID, *GROUP, F.col(limit).alias("a"), F.lit(True).alias("was")).join(
        new.select(GID, *GROUP, F.col(limit).alias("b"), F.lit(True).alias("is")), [GID, *GROUP], "full"
    )
    return both.filter("was is null or is is null or not (a <=> b)").select(GID, *GROUP)


def _others(old: DataFrame, days: DataFrame, moved: DataFrame) -> DataFrame:
    return old.drop("year").join(days, "day", "left_anti").join(moved.select(GID), GID, "left_anti")


def _year(day: Column | str) -> Column:
    return F.year(F.date_from_unix_date(day))


def _by_year(partials: DataFrame) -> DataFrame:
    return partials.withColumn("year", _year("day"))


def _stored(fingerprints: DataFrame) -> DataFrame:
    return fingerprints.drop(*OF_GROUP).withColumn("year", F.year("window_end"))


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def _write(frame: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    # One file or a few for each partition, wherever its rows were made.
    frame.repartition(*partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def _replace(frame: DataFrame, path: str, partition_by: Sequence[str], were: DataFrame) -> None:
    """Write the partitions of ``frame``, then delete those of ``were`` that have no row left."""
    spark = frame.sparkSession
    names = list(partition_by)
    empty = were.select(*names).distinct().join(frame.select(*names).distinct(), names, "left_anti").collect()
    _write(frame, path, names)
    for row in empty:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([path, *[f"{n}={row[n]}" for n in names]]))
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
