"""Sliding-window state fingerprints.

Scale comes from the order of the steps. Events are first reduced to daily
partials per (population, region, epoch): counts and sums, plus small weighted
histograms of magnitude, depth and place. That reduction combines on the map
side, so a region with a third of all events costs no more shuffle than any
other. Everything after it is bounded by the calendar, and only then are days
spread over the windows that contain them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.fixed_values import EARTH_RADIUS_KM
from quakeloom.functions.scalar import (
    clip,
    effective_sample_size,
    overlap_factor,
    seismic_energy_joule,
    wilson_interval,
)
from quakeloom.operators.distributed import prior_not_greater
from quakeloom.operators.epochs import (
    epoch_key,
    epoch_thresholds,
    histogram_centre,
    histogram_index,
)
from quakeloom.operators.magnitude import is_background, is_preferred, is_validated
from quakeloom.session import in_stretches, spread_evenly, staged, with_row_key

MODES = ("complete", "declustered")
POLICIES = ("operational", "validated")
POPULATION = ["catalogue_mode", "magnitude_policy"]
GROUP = [*POPULATION, "tectonic_domain", "observation_epoch"]
# A population's region and epoch as one number: narrow keys for what follows.
GID = "gid"
WINDOW = [GID, "window_days", "window_index"]
MAGNITUDE, DEPTH, PLACE = 0, 1, 2  # kinds of daily histogram
DEPTH_BUCKET_KM = 1.0
DISTANCE_BUCKET_KM = 1.0


def populations(
    frame: DataFrame, modes: Sequence[str] = MODES, policies: Sequence[str] = POLICIES
) -> DataFrame:
    """Each preferred event once per population it belongs to (a narrow step)."""
    members = []
    for mode in modes:
        for policy in policies:
            inside = F.lit(True)
            if mode == "declustered":
                inside = inside & is_background()
            if policy == "validated":
                inside = inside & is_validated()
            members.append(
                F.when(
                    inside,
                    F.struct(F.lit(mode).alias("catalogue_mode"), F.lit(policy).alias("magnitude_policy")),
                )
            )
    located = frame.filter(is_preferred()).filter(
        "origin_time_utc is not null and tectonic_domain is not null"
    )
    return located.select(
        F.explode(F.array(*members)).alias("_p"),
        "tectonic_domain",
        epoch_key(F.col("origin_time_utc")).alias("observation_epoch"),
        F.unix_micros("origin_time_utc").alias("ts"),
        F.unix_date(F.to_date("origin_time_utc")).alias("day"),
        "magnitude_comparable",
        "depth_km",
        "latitude",
        "longitude",
        "quality_score",
        F.upper(F.coalesce("source", F.lit("OTHER"))).alias("source"),
    ).filter("_p is not null").select("_p.*", *[c for c in (
        "tectonic_domain", "observation_epoch", "ts", "day", "magnitude_comparable",
        "depth_km", "latitude", "longitude", "quality_score", "source",
    )])


def spread_days(daily: DataFrame, window_days: Sequence[int], step_days: int) -> DataFrame:
    """Attach every window that contains a day.

    Windows of a group start at its first day d0 and advance by the step;
    window i of width w covers days [i*step, i*step + w - 1] after d0, and the
    last one ends no later than the last day. Needs ``d0`` and ``span``
    (last day - d0) columns.
    """
    offset = F.col("day") - F.col("d0")
    choices = []
    for w in window_days:
        first = F.greatest(F.lit(0), F.ceil((offset - (w - 1)) / F.lit(step_days)))
        last = F.least(
            F.floor(offset / F.lit(step_days)), F.floor((F.col("span") - (w - 1)) / F.lit(step_days))
        )
        choices.append(
            F.when(
                (F.col("span") >= w - 1) & (first <= last),
                F.struct(
                    F.lit(int(w)).alias("window_days"),
                    F.sequence(first.cast("int"), last.cast("int")).alias("indices"),
                ),
            )
        )
    return (
        daily.withColumn("_w", F.explode(F.array(*choices)))
        .filter("_w is not null")
        .withColumn("window_days", F.col("_w.window_days"))
        .withColumn("window_index", F.explode("_w.indices"))
        .drop("_w")
    )


def daily_sums(events: DataFrame) -> DataFrame:
    """Counts and sums per (group, day, source)."""
    m, comparable = F.col("magnitude_comparable"), F.col("comparable")

    def when(value: Column) -> Column:
        return F.when(comparable, value)

    placed = comparable & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    strong = m >= F.greatest(F.lit(3.0), F.col("threshold"))
    return events.groupBy(GID, "day", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("magnitude_comparable").alias("n_mag"),
        F.min("magnitude_comparable").alias("mag_min"),
        F.sum("quality_score").alias("q_sum"),
        F.count("quality_score").alias("q_n"),
        F.count_if(comparable).alias("c_n"),
        F.sum(when(m)).alias("mag_sum"),
        F.max(when(m)).alias("mag_max"),
        F.sum(when(seismic_energy_joule(m))).alias("energy"),
        F.count(when(F.col("depth_km"))).alias("depth_n"),
        F.count_if(placed).alias("loc_n"),
        F.sum(F.when(placed, F.col("latitude"))).alias("lat_sum"),
        F.sum(F.when(placed, F.col("longitude"))).alias("lon_sum"),
        F.max(F.when(strong, F.col("ts"))).alias("strong_ts"),
    )


def daily_histograms(events: DataFrame) -> DataFrame:
    """Weighted distinct values per (group, day), for three kinds of value."""
    comparable = F.col("comparable")

    def entry(kind: int, condition: Column, a: Column, b: Column) -> Column:
        return F.when(
            condition, F.struct(
                F.lit(kind).cast("tinyint").alias("kind"), a.alias("a"), b.alias("b")
            )
        )

    nothing = F.lit(None).cast("double")
    m, d = F.col("magnitude_comparable"), F.col("depth_km")
    lat, lon = F.col("latitude"), F.col("longitude")
    entries = F.array(
        entry(MAGNITUDE, m.isNotNull(), m, nothing),
        entry(DEPTH, comparable & d.isNotNull(), d, nothing),
        entry(PLACE, comparable & lat.isNotNull() & lon.isNotNull(), lat, lon),
    )
    return (
        events.select(GID, "day", F.explode(entries).alias("_e"))
        .filter("_e is not null")
        .select(GID, "day", "_e.*")
        .groupBy(GID, "day", "kind", "a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _window_sums(daily: DataFrame) -> DataFrame:
    """Window totals from daily sums already spread over windows."""
    additive = ["n", "n_mag", "q_sum", "q_n", "c_n", "mag_sum", "energy", "depth_n", "loc_n",
                "lat_sum", "lon_sum"]
    per_source = daily.groupBy(*WINDOW, "d0", "source").agg(
        *[F.sum(c).alias(c) for c in additive],
        F.max("mag_max").alias("mag_max"),
        F.min("mag_min").alias("mag_min"),
    )

    def count_of(name: str) -> Column:
        return F.sum(F.when(F.col("source") == name, F.col("n")).otherwise(0))

    return per_source.groupBy(*WINDOW, "d0").agg(
        *[F.sum(c).alias(c) for c in additive],
        F.max("mag_max").alias("mag_max"),
        F.min("mag_min").alias("mag_min"),
        count_of("IPMA").alias("n_ipma"),
        count_of("ISC").alias("n_isc"),
        count_of("AHEAD").alias("n_ahead"),
        F.min_by("source", F.struct(-F.col("n"), F.col("source"))).alias("dominant_source"),
    )


def _on_sphere(lat: Column, lon: Column) -> dict[str, Column]:
    """A place as a point of the unit sphere."""
    lat, lon = F.radians(lat), F.radians(lon)
    return {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}


def _arc_km(chord: Column) -> Column:
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(chord / 2, F.lit(1.0)))


def placed_entries(histograms: DataFrame) -> DataFrame:
    """Daily histograms with the places' points, made once a day and not once a window."""
    return histograms.withColumns(
        {c: F.when(F.col("kind") == PLACE, e) for c, e in _on_sphere(F.col("a"), F.col("b")).items()}
    ).drop("b")


def _centres(sums: DataFrame) -> DataFrame:
    """Centroids of the windows as points of the unit sphere."""
    lat, lon = F.col("lat_sum") / F.col("loc_n"), F.col("lon_sum") / F.col("loc_n")
    return sums.select(*WINDOW, "mag_min", *[e.alias(f"c_{c}") for c, e in _on_sphere(lat, lon).items()])


def _value() -> Column:
    """An entry's value in a window: a magnitude, a depth, or the chord from a place to the centroid.

    A chord of the unit sphere grows with the distance, so ranks among chords are
    those among distances, at the cost of one root for each entry and window.
    """
    dx, dy, dz = (F.col(c) - F.col(f"c_{c}") for c in "xyz")
    return F.when(F.col("kind") == PLACE, F.sqrt(dx * dx + dy * dy + dz * dz)).otherwise(F.col("a"))


def _kilometre() -> Column:
    """Bucket of a depth, or of a chord."""
    scale = F.when(F.col("kind") == DEPTH, 1 / DEPTH_BUCKET_KM).otherwise(EARTH_RADIUS_KM / DISTANCE_BUCKET_KM)
    return F.floor(F.col("value") * scale)


def _distribution_features(histograms: DataFrame, sums: DataFrame) -> DataFrame:
    """Mc, median depth, depth deviation and dispersion per window.

    Bucket totals locate the middle ranks; only the buckets that hold them are
    looked at value by value.
    """
    centres = staged(_centres(sums))
    index = histogram_index(F.col("a"), F.col("mag_min"), 0.1)
    entries = histograms.join(centres, WINDOW).withColumn("value", _value()).withColumn(
        "bucket", F.when(F.col("kind") == MAGNITUDE, index).otherwise(_kilometre())
    )
    width = F.col("value") - F.col("bucket")  # depth offset inside its kilometre
    is_depth = F.col("kind") == DEPTH
    buckets = entries.groupBy(*WINDOW, "kind", "bucket").agg(
        F.sum("n").alias("n"),
        F.min("mag_min").alias("mag_min"),
        F.sum(F.when(is_depth, F.col("n") * width)).alias("s1"),
        F.sum(F.when(is_depth, F.col("n") * width * width)).alias("s2"),
    )
    by_kind = Window.partitionBy(*WINDOW, "kind")
    upto = by_kind.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    mean = F.col("bucket") + F.col("s1") / F.col("n")
    ranked = staged(buckets.select(
        *WINDOW,
        "kind",
        "bucket",
        "n",
        "mag_min",
        mean.alias("mean"),
        F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.lit(0.0)).alias("m2"),
        F.sum("n").over(upto).alias("hi"),
        F.sum("n").over(by_kind).alias("total"),
        F.max("n").over(by_kind).alias("top"),
        (F.sum(F.col("n") * mean).over(by_kind) / F.sum("n").over(by_kind)).alias("grand"),
    ))
    # one pass for what bucket totals already answer
    spread = F.col("mean") - F.col("grand")
    simple = ranked.groupBy(*WINDOW).agg(
        F.min(
            F.when((F.col("kind") == MAGNITUDE) & (F.col("n") == F.col("top")), F.col("bucket"))
        ).alias("_peak"),
        F.max(F.when(F.col("kind") == MAGNITUDE, F.col("total"))).alias("_mags"),
        F.max("mag_min").alias("_mag_min"),
        F.max(F.when(is_depth, F.col("total"))).alias("_depths"),
        F.sum(F.when(is_depth, F.col("m2") + F.col("n") * spread * spread)).alias("_m2"),
    )
    lo, hi = F.col("hi") - F.col("n"), F.col("hi")
    first = F.floor((F.col("total") - 1) / 2)
    second = F.ceil((F.col("total") - 1) / 2)
    # At most two rows per window and kind; staged so that its size is known and
    # the second look at the entries joins it without moving them. That look meets
    # one row per window and kind, and leaves magnitudes out: a short loop.
    targets = staged(ranked.filter(F.col("kind") != MAGNITUDE).filter(
        ((first >= lo) & (first < hi)) | ((second >= lo) & (second < hi))
    ).select(*WINDOW, "kind", "bucket", lo.alias("lo"), first.alias("first"), second.alias("second")))
    sought = staged(
        targets.groupBy(*WINDOW, "kind").agg(F.min("bucket").alias("_b1"), F.max("bucket").alias("_b2"))
        .join(centres.drop("mag_min"), WINDOW)
    )
    values = (
        histograms.filter(F.col("kind") != MAGNITUDE)
        .join(sought, [*WINDOW, "kind"])
        .withColumn("value", _value())
        .withColumn("bucket", _kilometre())
        .filter((F.col("bucket") == F.col("_b1")) | (F.col("bucket") == F.col("_b2")))
        .groupBy(*WINDOW, "kind", "bucket", "value")
        .agg(F.sum("n").alias("n"))
        .join(targets, [*WINDOW, "kind", "bucket"])
    )
    within = (
        Window.partitionBy(*WINDOW, "kind", "bucket").orderBy("value")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = values.withColumn("e", F.col("lo") + F.sum("n").over(within))
    start, end = F.col("e") - F.col("n"), F.col("e")

    def middle(kind: int, measure: Callable[[Column], Column] = lambda value: value) -> Column:
        mine = F.col("kind") == kind
        low = F.max(F.when(mine & (F.col("first") >= start) & (F.col("first") < end), F.col("value")))
        high = F.max(F.when(mine & (F.col("second") >= start) & (F.col("second") < end), F.col("value")))
        return (measure(low) + measure(high)) / 2

    medians = placed.groupBy(*WINDOW).agg(
        middle(DEPTH).alias("median_depth_km"), middle(PLACE, _arc_km).alias("_dispersion")
    )
    return simple.join(medians, WINDOW, "left").select(
        *WINDOW,
        "median_depth_km",
        "_dispersion",
        F.when(F.col("_depths") > 1, F.sqrt(F.col("_m2") / F.col("_depths"))).alias("_depth_std"),
        F.when(
            F.col("_mags") >= 20, histogram_centre(F.col("_peak"), F.col("_mag_min"), 0.1)
        ).alias("catalogue_completeness_mc"),
    )


def last_strong(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """Latest strong event strictly before midnight of each window end."""
    strong = (
        daily.filter("strong_ts is not null")
        .groupBy(GID, "day").agg(F.max("strong_ts").alias("strong_ts"))
        .withColumn("window_days", F.lit(None).cast("int"))
        .withColumn("window_index", F.lit(None).cast("int"))
    )
    asked = windows.select(
        GID, F.col("end_day").alias("day"), F.lit(None).cast("long").alias("strong_ts"),
        "window_days", "window_index",
    )
    before = Window.partitionBy(GID).orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    return (
        strong.unionByName(asked)
        .withColumn("last_strong", F.max("strong_ts").over(before))
        .filter("window_days is not null")
        .select(*WINDOW, "last_strong")
    )


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def _shares() -> dict[str, Column]:
    ipma, isc, ahead = (F.col(c) / F.col("n") for c in ("n_ipma", "n_isc", "n_ahead"))
    other = F.greatest(F.lit(0.0), F.lit(1.0) - (ipma + isc + ahead))
    return {
        "source_share_ipma": ipma,
        "source_share_isc": isc,
        "source_share_ahead": ahead,
        "source_share_other": other,
    }


def diversity(shares: Iterable[Column]) -> Column:
    """Shannon entropy over four source classes, scaled to [0, 1]."""
    total = F.lit(0.0)
    for share in shares:
        total = total + F.when(share > 0, -share * F.ln(share)).otherwise(0.0)
    return clip(total / math.log(4.0), 0.0, 1.0)


def with_comparable(events: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Members of populations with their group's number and whether they are comparable."""
    limits = thresholds.select(GID, *GROUP, F.col("comparison_threshold").alias("threshold"))
    return events.join(limits, GROUP).withColumn(
        "comparable", F.coalesce(F.col("magnitude_comparable") >= F.col("threshold"), F.lit(False))
    )


def day_limits(daily: DataFrame) -> DataFrame:
    """First day and span of every group."""
    return daily.groupBy(GID).agg(F.min("day").alias("d0"), (F.max("day") - F.min("day")).alias("span"))


def windows_of_days(
    daily: DataFrame,
    histograms: DataFrame,
    anchors: DataFrame,
    window_days: Sequence[int],
    step_days: int,
    minimum_window_events: int,
    only: DataFrame | None = None,
) -> DataFrame:
    """Sums and distributions of windows (of ``only``, keys of windows, if given) from daily partials."""

    def spread(frame: DataFrame) -> DataFrame:
        found = spread_days(frame.join(anchors, GID), window_days, step_days)
        return found if only is None else found.join(only, WINDOW, "left_semi")

    sums = staged(_window_sums(spread(spread_evenly(daily, GID, "day"))).filter(F.col("n") >= minimum_window_events))
    # Neighbouring days meet the same windows, so a task that holds a stretch of days adds up
    # nearly all of its rows before they move; a long day still spreads over tasks.
    shapes = _distribution_features(spread(in_stretches(placed_entries(histograms), GID, "day", "a")), sums)
    start_day = F.col("d0") + F.col("window_index") * step_days
    return (
        sums.withColumn("start_day", start_day)
        .withColumn("end_day", start_day + F.col("window_days") - 1)
        .join(shapes, WINDOW, "left")
    )


def midnight(day: str) -> Column:
    return F.timestamp_seconds(F.col(day).cast("long") * 86400)


def days_since(end_day: str, last_strong: str) -> Column:
    since = (F.unix_micros(midnight(end_day)) - F.col(last_strong)) / F.lit(86_400_000_000.0)
    return F.when(F.col(last_strong).isNotNull(), F.greatest(F.lit(0.0), since))


def window_features(
    frame: DataFrame,
    window_days: Sequence[int] = (30, 90, 365),
    step_days: int = 7,
    minimum_window_events: int = 1,
    modes: Sequence[str] = MODES,
    policies: Sequence[str] = POLICIES,
) -> DataFrame:
    """All window features, without the expanding percentiles."""
    events = populations(frame, modes, policies)
    thresholds = with_row_key(epoch_thresholds(events, POPULATION), GID)
    events = with_comparable(events, thresholds)
    # The raw events are read for the last time here; what follows works on
    # daily partials, staged once and reused.
    daily = staged(daily_sums(events))
    histograms = staged(daily_histograms(events))
    anchors = staged(day_limits(daily))
    windows = windows_of_days(daily, histograms, anchors, window_days, step_days, minimum_window_events)
    return feature_columns(windows.join(last_strong(daily, windows), WINDOW, "left").join(thresholds, GID))


def feature_columns(full: DataFrame) -> DataFrame:
    """The columns of a fingerprint from window totals, thresholds and the last strong event."""
    shares = _shares()
    return full.select(
        "tectonic_domain",
        *POPULATION,
        "window_days",
        midnight("start_day").alias("window_start"),
        midnight("end_day").alias("window_end"),
        F.col("observation_epoch").alias("comparison_epoch"),
        F.col("epoch_label").alias("comparison_epoch_label"),
        F.col("comparison_threshold").alias("comparison_magnitude_threshold"),
        F.col("estimated_mc").alias("epoch_catalogue_mc"),
        F.col("epoch_event_count").cast("long").alias("epoch_event_count"),
        F.col("n").alias("event_count"),
        (F.col("n") * 30 / F.col("window_days")).alias("event_rate_per_30d"),
        F.col("c_n").alias("comparable_event_count"),
        (F.col("c_n") * 30 / F.col("window_days")).alias("comparable_event_rate_per_30d"),
        F.col("mag_max").alias("maximum_magnitude"),
        _ratio("mag_sum", "c_n").alias("mean_magnitude"),
        "median_depth_km",
        F.coalesce("_depth_std", F.lit(0.0)).alias("depth_std_km"),
        F.when(F.col("loc_n") >= 2, F.col("_dispersion")).otherwise(0.0).alias("spatial_dispersion_km"),
        F.when(F.col("energy") > 0, F.log10("energy")).alias("log10_total_energy_j"),
        "catalogue_completeness_mc",
        _ratio("q_sum", "q_n").alias("data_quality_score"),
        _ratio("n_mag", "n").alias("magnitude_coverage_ratio"),
        _ratio("depth_n", "c_n").alias("depth_coverage_ratio"),
        _ratio("loc_n", "c_n").alias("location_coverage_ratio"),
        *[share.alias(name) for name, share in shares.items()],
        diversity(shares.values()).alias("source_diversity_score"),
        "dominant_source",
        days_since("end_day", "last_strong").alias("days_since_previous_m3"),
    )


def running_percentiles(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    prefix: str,
    window_days: Column | int,
    step_days: int = 7,
    minimum_reference: int = 10,
    order: str = "window_end",
) -> DataFrame:
    """Expanding percentile of each row among earlier rows of its series, with
    lag-1 autocorrelation, effective sample size and Wilson bounds.

    ``value`` may be a count in place of a rate: ranks and correlations do not
    depend on the scale, and integers keep a constant series exactly constant.
    """
    keys = list(keys)
    series = Window.partitionBy(*keys).orderBy(order)
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    ranked = prior_not_greater(frame, keys, order, value, "_le")
    v = F.col(value).cast("double")
    base = ranked.withColumn("_prev", F.last(v, ignorenulls=True).over(before))
    pair = v.isNotNull() & F.col("_prev").isNotNull()

    def running(column: Column) -> Column:
        return F.sum(F.when(pair, column)).over(before)

    x, y = F.col("_prev"), v
    base = base.withColumns(
        {
            "_n": F.count(value).over(before),
            "_k": F.coalesce(F.count(F.when(pair, 1)).over(before), F.lit(0)),
            "_x": running(x), "_y": running(y), "_xx": running(x * x),
            "_yy": running(y * y), "_xy": running(x * y),
        }
    )
    k = F.col("_k")
    var_x = F.greatest(k * F.col("_xx") - F.col("_x") * F.col("_x"), F.lit(0.0))
    var_y = F.greatest(k * F.col("_yy") - F.col("_y") * F.col("_y"), F.lit(0.0))
    spread = F.sqrt(var_x * var_y)
    rho = F.when(
        (k >= 2) & (spread > 0),
        clip((k * F.col("_xy") - F.col("_x") * F.col("_y")) / spread, -0.99, 0.99),
    )
    base = base.withColumn("_rho", rho).withColumn("_overlap", overlap_factor(window_days, step_days))
    base = base.withColumn(
        "_eff", effective_sample_size(F.col("_n"), F.col("_overlap"), F.col("_rho"))
    ).withColumn(
        "_p",
        F.when((F.col("_n") >= minimum_reference) & v.isNotNull(), F.col("_le") / F.col("_n")),
    )
    lower, upper = wilson_interval(F.col("_p"), F.col("_eff"))
    return base.select(
        *frame.columns,
        F.col("_p").alias(f"{prefix}_percentile_event_rate"),
        F.col("_n").cast("int").alias(f"{prefix}_reference_windows"),
        F.col("_eff").alias(f"{prefix}_effective_sample_size"),
        lower.alias(f"{prefix}_percentile_ci_lower"),
        upper.alias(f"{prefix}_percentile_ci_upper"),
        F.col("_overlap").alias(f"{prefix}_overlap_factor"),
        F.col("_rho").alias(f"{prefix}_lag1_autocorrelation"),
    )


def add_percentiles(features: DataFrame, step_days: int = 7, minimum_reference: int = 10) -> DataFrame:
    keys = [*POPULATION, "tectonic_domain", "window_days"]
    once = running_percentiles(
        features, keys, "event_count", "historical", F.col("window_days"), step_days, minimum_reference
    )
    return running_percentiles(
        once, [*keys, "comparison_epoch"], "comparable_event_count", "comparable",
        F.col("window_days"), step_days, minimum_reference,
    )


def build_fingerprints(
    frame: DataFrame,
    window_days: Sequence[int] = (30, 90, 365),
    step_days: int = 7,
    minimum_window_events: int = 1,
    minimum_reference_windows: int = 10,
    modes: Sequence[str] = ("complete",),
    policies: Sequence[str] = ("operational",),
) -> DataFrame:
    """Fingerprints of one or more populations in a single plan."""
    features = window_features(
        frame, window_days, step_days, minimum_window_events, modes, policies
    )
    return add_percentiles(staged(features), step_days, minimum_reference_windows)
