"""Catalogue and fingerprint summaries, display tables and map data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.fixed_values import (
    LABEL_HIGH,
    LABEL_NONE,
    LABEL_NORMAL,
    LABEL_WATCH,
    NO_LOCATION,
    NO_SOURCE,
    SOURCE_DISPLAY,
    STATE_BASELINE,
    STATE_CROSSING,
    STATE_ELEVATED,
    STATE_EXCEPTIONAL,
    STATE_MISSING,
    STATE_SMALL,
)
from quakeloom.functions.display import (
    fixed_decimals,
    format_date_pt,
    format_datetime,
    format_month,
)
from quakeloom.functions.scalar import clip, extract_year
from quakeloom.operators.distributed import running_totals, weighted_quantiles
from quakeloom.operators.epochs import estimate_completeness
from quakeloom.operators.magnitude import is_preferred, preferred_events


def consolidation_summary(frame: DataFrame) -> DataFrame:
    raw, kept = F.count(F.lit(1)), F.count_if(is_preferred())
    return frame.agg(
        raw.alias("raw_records"),
        kept.alias("consolidated_events"),
        (raw - kept).alias("redundant_records"),
        F.count_distinct("duplicate_group_id").alias("duplicate_groups"),
        F.coalesce(F.try_divide(raw - kept, raw), F.lit(0.0)).alias("consolidation_rate"),
    )


def source_pipeline_status(frame: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """State and next action per expected source.

    ``snapshots``: source, snapshot_count, last_snapshot (timestamp), as
    :func:`quakeloom.sources.bronze.snapshot_counts` returns them.
    """
    spark = frame.sparkSession
    expected = spark.createDataFrame(
        [(s, SOURCE_DISPLAY[s]) for s in ("IPMA", "AHEAD", "ISC")], "source string, source_label string"
    )
    counts = frame.groupBy("source").agg(
        F.count(F.lit(1)).alias("silver_records"),
        F.count_if(is_preferred()).alias("consolidated_events"),
        F.max("origin_time_utc").alias("last_event"),
    )
    if snapshots is None:
        snapshots = spark.createDataFrame(
            [], "source string, snapshot_count long, last_snapshot timestamp"
        )
    raw, kept, files = (
        F.coalesce(F.col(c), F.lit(0)) for c in ("silver_records", "consolidated_events", "snapshot_count")
    )

    def decide(a: str, b: str, c: str, d: str) -> Column:
        return F.when(kept > 0, a).when(raw > 0, b).when(files > 0, c).otherwise(d)

    return (
        expected.join(counts, "source", "left")
        .join(snapshots, "source", "left")
        .select(
            F.col("source_label").alias("source"),
            decide("Integrada", "Presente no Silver", "Recolhida", "Não recolhida").alias("state"),
            files.alias("bronze_snapshots"),
            raw.alias("silver_records"),
            kept.alias("consolidated_events"),
            format_date_pt(F.col("last_event"), True).alias("last_event"),
            format_date_pt(F.col("last_snapshot"), True).alias("last_snapshot"),
            decide(
                "Nenhuma", "Rever preferência/deduplicação", "Reconstruir Silver e Gold",
                "Executar ingestão",
            ).alias("next_action"),
        )
    )


def calendar_span(frame: DataFrame, time: str = "origin_time_utc") -> DataFrame:
    year = extract_year(F.col(time))
    return frame.agg(F.coalesce(F.max(year) - F.min(year), F.lit(0)).alias("calendar_span_years"))


def temporal_aggregation(frame: DataFrame, time: str = "origin_time_utc") -> DataFrame:
    """Events per year when the calendar span exceeds 15 years, else per month.

    Months are counted first (a map-side combine), so the span is a window
    over at most a few thousand month rows.
    """
    months = (
        frame.filter(F.col(time).isNotNull())
        .groupBy(extract_year(F.col(time)).alias("year"), format_month(F.col(time)).alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = Window.partitionBy(F.lit(0))
    by_year = (F.max("year").over(every) - F.min("year").over(every)) > 15
    period = F.when(by_year, F.col("year").cast("string")).otherwise(F.col("month"))
    return (
        months.select(period.alias("period"), "n")
        .groupBy("period").agg(F.sum("n").alias("events")).orderBy("period")
    )


def fractional_date(
    frame: DataFrame, fraction: float, time: str = "origin_time_utc", truncate: bool = False
) -> DataFrame:
    """The date at position round((n-1)*f) of the sorted dates (or truncated),
    from running totals over distinct times; no global sort in one task."""
    f = min(max(float(fraction), 0.0), 1.0)
    times = frame.filter(F.col(time).isNotNull()).groupBy(F.col(time).alias("date")).agg(
        F.count(F.lit(1)).alias("n")
    )
    placed = running_totals(times.withColumn("_k", F.lit(0)), ["_k"], [F.asc("date")], {"upto": F.col("n")})
    total = times.agg(F.sum("n").alias("total"))
    position = (F.col("total") - 1) * F.lit(f)
    index = F.floor(position) if truncate else F.bround(position, 0)
    return (
        placed.join(F.broadcast(total), F.lit(True))  # one row
        .filter((F.col("upto") - F.col("n") <= index) & (index < F.col("upto")))
        .select("date")
    )


def source_table(frame: DataFrame) -> DataFrame:
    return (
        preferred_events(frame)
        .filter("source is not null")
        .groupBy("source")
        .agg(
            F.count("event_id").alias("events"),
            F.min("origin_time_utc").alias("first_event"),
            F.max("origin_time_utc").alias("last_event"),
            F.avg("quality_score").alias("mean_quality"),
        )
    )


def epoch_table(fingerprints: DataFrame) -> DataFrame:
    """Window span, count and median Mc per epoch and threshold."""
    keys = ["comparison_epoch", "comparison_epoch_label", "comparison_magnitude_threshold"]
    base = fingerprints.groupBy(*keys).agg(
        F.min("window_end").alias("first_window"),
        F.max("window_end").alias("last_window"),
        F.count("window_end").alias("windows"),
    )
    medians = weighted_quantiles(
        fingerprints.withColumn("_one", F.lit(1)), keys, "catalogue_completeness_mc", "_one", 0.1,
        {"median_mc": 0.5},
    )
    return base.join(medians, keys, "left")


def magnitude_histogram(frame: DataFrame, bins: int = 28) -> DataFrame:
    """Equal-width bins over the observed range; the top edge joins the last."""
    values = frame.filter(F.col("magnitude_comparable").between(-3.0, 10.5)).groupBy(
        F.col("magnitude_comparable").alias("m")
    ).agg(F.count(F.lit(1)).alias("n"))
    span = values.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.least(F.floor((F.col("m") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    return (
        values.join(F.broadcast(span), F.lit(True))  # one row
        .select(F.coalesce(index, F.lit(0)).cast("int").alias("bin"), "lo", width.alias("width"), "n")
        .groupBy("bin", "lo", "width")
        .agg(F.sum("n").alias("events"))
        .select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"), "events")
        .orderBy("bin")
    )


def counts_by(frame: DataFrame, column: str) -> DataFrame:
    return frame.groupBy(column).agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"), column)


def completeness_by_domain(frame: DataFrame) -> DataFrame:
    return estimate_completeness(
        preferred_events(frame).filter("tectonic_domain is not null"), ["tectonic_domain"]
    )


def latest_per_group(fingerprints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last window per group; ``max_by`` combines on the map side."""
    others = [c for c in fingerprints.columns if c not in keys]
    return (
        fingerprints.groupBy(*keys)
        .agg(F.max_by(F.struct(*others), F.col("window_end")).alias("_r"))
        .select(*keys, "_r.*")
    )


def current_window(frame: DataFrame, days: int, time: str = "origin_time_utc") -> DataFrame:
    """Rows of the last ``days`` days up to the latest one, both ends included."""
    latest = frame.agg(F.max(time).alias("_latest"))
    start = F.col("_latest") - F.expr(f"interval {int(days)} days")
    return (
        frame.join(F.broadcast(latest), F.lit(True))  # one row
        .filter(F.col(time).between(start, F.col("_latest")))
        .select(*frame.columns)
    )


def _state(pair: tuple[str, str]) -> Column:
    return F.struct(F.lit(pair[0]).alias("label"), F.lit(pair[1]).alias("level"))


def activity_state(
    percentile: Column, lower: Column, upper: Column, effective: Column,
    elevated: float = 0.80, exceptional: float = 0.95, minimum_effective: float = 5.0,
) -> Column:
    """struct(label, level) from the interval, first rule that applies."""
    missing = percentile.isNull() | lower.isNull() | upper.isNull() | effective.isNull()
    return (
        F.when(missing, _state(STATE_MISSING))
        .when(effective < minimum_effective, _state(STATE_SMALL))
        .when(lower >= exceptional, _state(STATE_EXCEPTIONAL))
        .when(lower >= elevated, _state(STATE_ELEVATED))
        .when(upper < elevated, _state(STATE_BASELINE))
        .otherwise(_state(STATE_CROSSING))
    )


def activity_label(percentile: Column) -> Column:
    return (
        F.when(percentile.isNull(), _state(LABEL_NONE))
        .when(percentile >= 0.95, _state(LABEL_HIGH))
        .when(percentile >= 0.75, _state(LABEL_WATCH))
        .otherwise(_state(LABEL_NORMAL))
    )


def bootstrap_intervals(
    series: DataFrame, keys: Sequence[str], resamples: int = 800, confidence: float = 0.95, seed: int = 42
) -> DataFrame:
    """Moving-block bootstrap of a percentile, per key.

    ``series``: keys, window_end, value (a prior value), target, block
    (NULL = cube root of n). Block starts come from the MD5 of seed, resample
    and block, so that they are the same everywhere. A key's row holds one
    region's windows, calendar-bounded; resamples are spread over tasks. With
    fewer than three prior values, or no target, the figures are NULL.
    """
    ordered = series.filter("value is not null and not isnan(value)").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("window_end", (F.col("value") <= F.col("target")).cast("int").alias("hit")))).alias("_s"),
        F.count(F.lit(1)).alias("_n"),
        F.first("block").cast("double").alias("_asked"),
        F.first("target").cast("double").alias("_target"),
    )
    wanted = F.coalesce(F.col("_asked"), F.round(F.pow(F.col("_n"), F.lit(1 / 3))))
    ready = ordered.select(
        *keys, "_n", (F.col("_target").isNotNull() & ~F.isnan("_target") & (F.col("_n") >= 3)).alias("_ok"),
        F.when(F.col("_n") >= 3, F.least(F.greatest(wanted, F.lit(2)), F.col("_n"))).otherwise(F.greatest(F.lit(1), wanted))
        .cast("int").alias("block_length"),
        # How many hits stand before each position.
        F.expr("aggregate(_s, array(0), (x, y) -> concat(x, array(element_at(x, -1) + coalesce(y.hit, 0))))").alias("_before"),
    )
    drawn = ready.filter("_ok").withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).select(
        *keys,
        F.expr(f"""
            aggregate(sequence(0L, (_n - 1) div block_length), 0, (total, b) -> total + aggregate(array(
                cast(conv(substr(md5(cast(concat_ws('|', {seed}, _r, b) as binary)), 1, 15), 16, 10) as bigint) % greatest(1, _n - block_length + 1)),
                0, (x, at) -> _before[cast(at + least(block_length, _n - b * block_length) as int)] - _before[cast(at as int)])) / _n
        """).alias("_share"),
    )
    tail = (1 - confidence) / 2
    intervals = drawn.groupBy(*keys).agg(
        F.expr(f"percentile(_share, array({tail}D, {1 - tail}D))").alias("_q")
    ).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_q")[0].alias("boot_lower"), F.col("_q")[1].alias("boot_upper"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return ready.join(intervals, same, "left").select(
        *keys, F.when(F.col("_ok"), F.element_at("_before", -1) / F.col("_n")).alias("point"),
        "boot_lower", "boot_upper", "block_length",
    )


def conservative_states(fingerprints: DataFrame) -> DataFrame:
    """Activity state of each region's latest window, on the wider of the
    Wilson and bootstrap intervals."""
    keys = ["catalogue_mode", "magnitude_policy", "tectonic_domain", "window_days"]
    latest = latest_per_group(fingerprints, keys)
    prior = (
        latest.alias("l")
        .join(fingerprints.alias("f"), [F.col(f"l.{k}") == F.col(f"f.{k}") for k in keys])
        .filter(
            (F.col("f.window_end") < F.col("l.window_end"))
            & (F.col("f.comparison_epoch") == F.col("l.comparison_epoch"))
        )
        .select(
            *[F.col(f"l.{k}").alias(k) for k in keys],
            F.col("f.window_end").alias("window_end"),
            F.col("f.comparable_event_rate_per_30d").alias("value"),
            F.col("l.comparable_event_rate_per_30d").alias("target"),
            F.col("l.comparable_overlap_factor").alias("block"),
        )
    )
    boot = bootstrap_intervals(prior, keys)
    joined = latest.join(boot, keys, "left")
    lower = F.least("comparable_percentile_ci_lower", "boot_lower")
    upper = F.greatest("comparable_percentile_ci_upper", "boot_upper")
    state = activity_state(
        F.col("comparable_percentile_event_rate"), F.col("ci_lower"), F.col("ci_upper"),
        F.col("comparable_effective_sample_size"),
    )
    return joined.withColumn("ci_lower", lower).withColumn("ci_upper", upper).select(
        *keys, "window_end", "comparable_percentile_event_rate", "ci_lower", "ci_upper",
        "comparable_effective_sample_size", state["label"].alias("state"), state["level"].alias("level"),
    )


def declustering_sensitivity(fingerprints: DataFrame) -> DataFrame:
    """Latest window of each catalogue mode side by side."""
    return latest_per_group(
        fingerprints, ["magnitude_policy", "tectonic_domain", "window_days", "catalogue_mode"]
    ).select(
        "magnitude_policy", "tectonic_domain", "window_days", "catalogue_mode", "window_end",
        "event_count", "comparable_event_rate_per_30d", "comparable_percentile_event_rate",
        "comparable_percentile_ci_lower", "comparable_percentile_ci_upper",
    )


# --- map data ---------------------------------------------------------------


def map_points(frame: DataFrame, minimum_magnitude: float) -> DataFrame:
    m = F.col("magnitude_comparable")
    shown = frame.filter(
        (m >= float(minimum_magnitude)) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    )
    location = F.coalesce(F.nullif("location_text", F.lit("")), F.lit(NO_LOCATION))
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit(NO_SOURCE))
    depth = F.when(F.col("depth_km").isNull(), "—").otherwise(
        F.concat(fixed_decimals(F.col("depth_km"), 1), F.lit(" km"))
    )
    return shown.select(
        "event_id", "latitude", "longitude", "magnitude_comparable",
        # a non-positive magnitude has no real power: it gets the smallest marker
        clip(F.when(m > 0, F.pow(m, F.lit(2.15))).otherwise(0.0) * 2.5, 7.0, 46.0).alias("marker_size"),
        F.concat(
            F.lit("<b>"), location, F.lit("</b><br>Data: "), format_datetime(F.col("origin_time_utc")),
            F.lit("<br>Magnitude: "), fixed_decimals(m, 1), F.lit("<br>Profundidade: "), depth,
            F.lit("<br>Fonte: "), source, F.lit("<br>Coordenadas: "),
            fixed_decimals(F.col("latitude"), 3), F.lit(", "), fixed_decimals(F.col("longitude"), 3),
        ).alias("hover_text"),
    )


def strongest(points: DataFrame, count: int) -> DataFrame:
    """A top-k report: the ``count`` strongest points."""
    return points.orderBy(F.desc("magnitude_comparable"), "event_id").limit(count)


def sample(points: DataFrame, count: int, seed: str = "") -> DataFrame:
    """A sampling operator: ``count`` points in the order of their ids' MD5."""
    drawn = F.md5(F.concat(F.lit(seed), F.col("event_id")).cast("binary"))
    return points.orderBy(drawn, "event_id").limit(count)


def strongest_and_sample(points: DataFrame, top: int, fill: int, seed: str = "") -> DataFrame:
    """What a point map shows: the ``top`` strongest and a sample of the others."""
    first = strongest(points, top)
    rest = points.join(first.select("event_id"), "event_id", "left_anti").select(*points.columns)
    return first.unionByName(sample(rest, fill, seed))


def density_grid(points: DataFrame, bins: int = 70) -> DataFrame:
    """At most bins x bins cells with mean position, count and capped log density."""
    # one row of extents
    box = points.agg(
        F.min("latitude").alias("lat0"), F.max("latitude").alias("lat1"),
        F.min("longitude").alias("lon0"), F.max("longitude").alias("lon1"),
    )

    def cell(value: str, low: str, high: str) -> Column:
        width = F.nullif((F.col(high) - F.col(low)) / bins, F.lit(0.0))
        index = F.floor((F.col(value) - F.col(low)) / width)
        return F.least(F.greatest(F.coalesce(index, F.lit(bins - 1)), F.lit(0)), F.lit(bins - 1)).cast("int")

    grid = (
        points.join(F.broadcast(box), F.lit(True))
        .select(
            cell("latitude", "lat0", "lat1").alias("latitude_bin"),
            cell("longitude", "lon0", "lon1").alias("longitude_bin"),
            "latitude", "longitude", "magnitude_comparable",
        )
        .groupBy("latitude_bin", "longitude_bin")
        .agg(
            F.avg("latitude").alias("latitude"),
            F.avg("longitude").alias("longitude"),
            F.count(F.lit(1)).alias("events"),
            F.max("magnitude_comparable").alias("maximum_magnitude"),
        )
        .withColumn("log_density", F.log1p("events"))
    )
    every = Window.partitionBy(F.lit(0))  # the cells, at most bins squared
    cap = F.greatest(F.expr("percentile(log_density, 0.99)").over(every), F.lit(1e-6))
    return grid.select(
        "*",
        F.least("log_density", cap).alias("display_density"),
        clip(F.sqrt("events") * 2.8 + 7.0, 8.0, 34.0).alias("marker_size"),
        F.concat(
            F.lit("<b>Célula de densidade</b><br>Eventos: "), F.col("events").cast("string"),
            F.lit("<br>M máxima: "), fixed_decimals(F.col("maximum_magnitude"), 1),
        ).alias("hover_text"),
    )


def map_view(points: DataFrame, bins: int = 70) -> DataFrame:
    """Centre, zoom and grid resolution of a map, one row."""
    lat, lon = F.col("latitude"), F.col("longitude")
    lat_span, lon_span = F.max(lat) - F.min(lat), F.max(lon) - F.min(lon)
    span = F.greatest(
        F.greatest(lat_span, F.lit(0.05)), F.greatest(lon_span, F.lit(0.05)) * 0.75
    )
    km = F.greatest(
        F.abs(lat_span) * 111.0,
        F.abs(lon_span) * 111.0 * F.greatest(F.cos(F.radians(F.avg(lat))), F.lit(0.2)),
    )
    return points.agg(
        F.avg(lat).alias("center_latitude"),
        F.avg(lon).alias("center_longitude"),
        F.coalesce(clip(F.lit(7.8) - F.log2(span + 0.15), 3.2, 8.5), F.lit(4.2)).alias("zoom"),
        (km / max(bins, 1)).alias("grid_resolution_km"),
    )


# --- context ----------------------------------------------------------------


def event_summary(frame: DataFrame, keys: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """Aggregate-only description of a catalogue selection; all sources, or the ``top`` most frequent."""
    keys = list(keys)
    one = frame.withColumn("_one", F.lit(1)) if keys else frame.withColumns(
        {"_one": F.lit(1), "_k": F.lit(0)}
    )
    groups = keys or ["_k"]
    base = one.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("origin_time_utc").alias("first_event"),
        F.max("origin_time_utc").alias("last_event"),
        F.round(F.max("magnitude_comparable"), 4).alias("maximum_magnitude"),
    )
    magnitude = weighted_quantiles(one, groups, "magnitude_comparable", "_one", 0.1, {"median_magnitude": 0.5})
    depth = weighted_quantiles(one, groups, "depth_km", "_one", 1.0, {"median_depth_km": 0.5})
    counts = one.groupBy(*groups, F.coalesce("source", F.lit("UNKNOWN")).alias("s")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rank = Window.partitionBy(*groups).orderBy(F.desc("n"), "s")
    top = (
        counts.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= top if top else F.lit(True))
        .groupBy(*groups)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("sources"))
    )
    joined = base.join(magnitude, groups, "left").join(depth, groups, "left").join(top, groups, "left")
    return joined if keys else joined.drop("_k")
