"""Observation epochs, magnitude of completeness and comparison thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeloom.fixed_values import EPOCHS
from quakeloom.functions.scalar import round_half_even_1
from quakeloom.session import staged


def _by_year(year: Column, pick: int) -> Column:
    """Epoch attribute for a year; NULL belongs to the last epoch, and years
    before the first epoch belong to the first."""
    chain = F.when(year.isNull(), F.lit(EPOCHS[-1][pick]))
    for epoch in EPOCHS[:-1]:
        chain = chain.when(year <= epoch[3], F.lit(epoch[pick]))
    return chain.otherwise(F.lit(EPOCHS[-1][pick]))


def epoch_key(time: Column) -> Column:
    return _by_year(F.year(time), 0)


def epoch_label(time: Column) -> Column:
    return _by_year(F.year(time), 1)


def epoch_floor(time: Column) -> Column:
    return _by_year(F.year(time), 4)


def epoch_start(time: Column) -> Column:
    return F.make_timestamp(
        _by_year(F.year(time), 2), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)
    )


def epoch_attribute(key: Column, pick: int) -> Column:
    """Attribute of an epoch given its key (1 label, 4 floor)."""
    chain = F.when(key == EPOCHS[0][0], F.lit(EPOCHS[0][pick]))
    for epoch in EPOCHS[1:]:
        chain = chain.when(key == epoch[0], F.lit(epoch[pick]))
    return chain


def assign_observation_epoch(frame: DataFrame, time: str = "origin_time_utc") -> DataFrame:
    return frame.withColumns(
        {
            "observation_epoch": epoch_key(F.col(time)),
            "observation_epoch_label": epoch_label(F.col(time)),
        }
    )


def histogram_lower(minimum: Column, width: float) -> Column:
    return F.floor(minimum / F.lit(width)) * F.lit(width)


def histogram_index(value: Column, minimum: Column, width: float) -> Column:
    """Bin of a value on edges lower + i * ((lower + width) - lower), all in
    doubles: a value belongs to the last edge that is not above it."""
    lower = histogram_lower(minimum, width)
    delta = (lower + F.lit(width)) - lower
    guess = F.floor((value - lower) / delta)
    down = F.when(value < lower + guess * delta, guess - 1).otherwise(guess)
    return F.when(value >= lower + (down + 1) * delta, down + 1).otherwise(down)


def histogram_centre(index: Column, minimum: Column, width: float) -> Column:
    lower = histogram_lower(minimum, width)
    delta = (lower + F.lit(width)) - lower
    return F.round(lower + index * delta + F.lit(width / 2), 2)


def completeness(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    minimum_events: int = 50,
    bin_width: float = 0.1,
) -> DataFrame:
    """Maximum-curvature Mc per key from weighted magnitudes.

    The first (lowest) bin with the largest count wins; NULL below
    ``minimum_events``. Output: keys, mc, event_count, sufficient_data.
    """
    if not keys:
        grouped = counts.withColumn("_all", F.lit(0))
        return completeness(grouped, ["_all"], value, weight, minimum_events, bin_width).drop("_all")
    keys = list(keys)
    observed = counts.filter(F.col(value).isNotNull())
    spans = observed.groupBy(*keys).agg(
        F.min(value).alias("_min"), F.sum(weight).alias("event_count")
    )
    joined = _join_null_safe(observed.select(*keys, value, weight), spans, keys)
    bins = (
        joined.select(
            *keys, "_min", "event_count", weight,
            histogram_index(F.col(value), F.col("_min"), bin_width).alias("_i"),
        )
        .groupBy(*keys, "_min", "event_count", "_i")
        .agg(F.sum(weight).alias("_c"))
    )
    peak = bins.groupBy(*keys, "_min", "event_count").agg(
        F.max_by("_i", F.struct("_c", -F.col("_i"))).alias("_peak")
    )
    enough = F.col("event_count") >= minimum_events
    return peak.select(
        *keys,
        F.when(enough, histogram_centre(F.col("_peak"), F.col("_min"), bin_width)).alias("mc"),
        F.col("event_count").cast("long").alias("event_count"),
        enough.alias("sufficient_data"),
    )


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return (
        left.alias("l")
        .join(right.alias("r"), condition)
        .select("l.*", *[f"r.{c}" for c in right.columns if c not in keys])
    )


def magnitude_counts(frame: DataFrame, keys: Sequence[Column | str], value: str = "magnitude_comparable") -> DataFrame:
    """Distinct magnitudes per key with their counts: the map-side combine that
    keeps a hot region from travelling as raw rows."""
    return frame.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def estimate_completeness(
    frame: DataFrame, keys: Sequence[str] = (), value: str = "magnitude_comparable",
    bin_width: float = 0.1, minimum_events: int = 50,
) -> DataFrame:
    return completeness(
        magnitude_counts(frame, list(keys), value), keys, value, "n", minimum_events, bin_width
    )


def add_epoch_completeness(frame: DataFrame, epoch_years: int = 10, minimum_events: int = 50) -> DataFrame:
    """Mc per (region, decade); groups without magnitudes keep a NULL row."""
    keyed = frame.select(
        "tectonic_domain",
        (F.floor(F.year("origin_time_utc") / F.lit(epoch_years)) * epoch_years)
        .cast("int").alias("epoch_start_year"),
        "magnitude_comparable",
    )
    keys = ["tectonic_domain", "epoch_start_year"]
    counts = magnitude_counts(keyed, keys)
    found = completeness(counts, keys, "magnitude_comparable", "n", minimum_events)
    every = counts.select(*keys).distinct()
    joined = every.alias("l").join(
        found.alias("r"),
        F.col("l.tectonic_domain").eqNullSafe(F.col("r.tectonic_domain"))
        & F.col("l.epoch_start_year").eqNullSafe(F.col("r.epoch_start_year")),
        "left",
    )
    return joined.select(
        "l.tectonic_domain",
        "l.epoch_start_year",
        F.col("r.mc").alias("catalogue_completeness_mc"),
        F.coalesce("r.event_count", F.lit(0)).alias("completeness_event_count"),
        F.coalesce("r.sufficient_data", F.lit(False)).alias("completeness_sufficient_data"),
    )


def epoch_thresholds(
    frame: DataFrame, extra_keys: Sequence[str] = (), minimum_events: int = 30
) -> DataFrame:
    """Comparison threshold per (extra keys, region, epoch): the larger of the
    policy floor and Mc, rounded to one decimal as Python rounds."""
    keys = [*extra_keys, "tectonic_domain", "observation_epoch"]
    # Staged, so that the events are read once for all that follows.
    counts = staged(magnitude_counts(frame.filter("tectonic_domain is not null"), keys))
    return thresholds_of_counts(counts, keys, minimum_events)


def thresholds_of_counts(counts: DataFrame, keys: Sequence[str], minimum_events: int = 30) -> DataFrame:
    """The same from counted magnitudes: keys, magnitude_comparable (or NULL) and n."""
    keys = list(keys)
    sizes = counts.groupBy(*keys).agg(
        F.sum("n").alias("epoch_event_count"),
        F.sum(F.when(F.col("magnitude_comparable").isNotNull(), F.col("n")).otherwise(0)).alias(
            "epoch_magnitude_count"
        ),
    )
    estimates = completeness(counts, keys, "magnitude_comparable", "n", minimum_events)
    joined = sizes.join(estimates.select(*keys, F.col("mc").alias("estimated_mc")), keys, "left")
    floor = epoch_attribute(F.col("observation_epoch"), 4)
    return joined.select(
        *keys,
        epoch_attribute(F.col("observation_epoch"), 1).alias("epoch_label"),
        floor.alias("policy_floor"),
        "estimated_mc",
        round_half_even_1(F.greatest(floor, "estimated_mc")).alias("comparison_threshold"),
        "epoch_event_count",
        "epoch_magnitude_count",
    )
