import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quakeloom.operators.fingerprints import build_fingerprints, running_percentiles, window_features
from quakeloom.operators.epochs import (
    epoch_thresholds, assign_observation_epoch, estimate_completeness,
)

SCHEMA = (
    "event_id string, source string, tectonic_domain string, origin_time_utc timestamp, latitude double, "
    "longitude double, depth_km double, magnitude_comparable double, quality_score double, "
    "is_preferred_record boolean, is_background_event boolean, magnitude_homogenization_status string"
)


def event(i, when, mag=2.0, depth=10.0, lat=38.0, lon=-9.0, source="ISC", domain="X"):
    return (str(i), source, domain, when, lat, lon, depth, mag, 0.5, True, True, "reviewed_identity")


def features(spark, rows, **options):
    options = {"modes": ("complete",), "policies": ("operational",), **options}
    return window_features(spark.createDataFrame(rows, SCHEMA), **options)


def test_window_bounds_and_previous_event(spark):
    """The last day counts whole; 'previous' stops at its midnight."""
    day = datetime(2020, 1, 1)
    rows = [
        event(0, day + timedelta(hours=5), 3.5),
        event(1, day + timedelta(days=29, hours=23), 3.2),
        event(2, day + timedelta(days=30), 3.9),
    ]
    out = features(spark, rows, window_days=(30,)).collect()
    assert len(out) == 1
    w = out[0]
    assert (w.window_start, w.window_end) == (day, day + timedelta(days=29))
    assert w.event_count == 2 and w.maximum_magnitude == 3.5
    assert w.days_since_previous_m3 == pytest.approx(29 - 5 / 24)


def test_empty_windows_are_left_out_and_short_series_give_none(spark):
    day = datetime(2020, 1, 1)
    rows = [event(0, day), event(1, day + timedelta(days=200))]
    out = features(spark, rows, window_days=(30, 365)).collect()
    assert {r.window_days for r in out} == {30}
    assert sorted((r.window_start - day).days for r in out) == [0]


def test_small_group_defaults(spark):
    day = datetime(2020, 1, 1)
    rows = [event(0, day, None), event(1, day + timedelta(days=40), 1.0)]
    w = features(spark, rows, window_days=(30,)).orderBy("window_end").first()
    assert w.comparable_event_count == 0 and w.maximum_magnitude is None
    assert (w.depth_std_km, w.spatial_dispersion_km) == (0.0, 0.0)
    assert w.depth_coverage_ratio is None and w.magnitude_coverage_ratio == 0.0
    assert w.log10_total_energy_j is None and w.catalogue_completeness_mc is None


def test_hot_day_and_hot_value(spark):
    """A third of all rows in one place, day and depth."""
    day = datetime(2020, 1, 1)
    rng = random.Random(3)
    rows = [event(i, day + timedelta(days=15), 2.0, 10.0) for i in range(300)]
    rows += [
        event(1000 + i, day + timedelta(days=rng.randint(0, 60)), round(rng.uniform(1.5, 4), 1),
              rng.uniform(0, 40), 38 + rng.uniform(-1, 1), -9 + rng.uniform(-1, 1))
        for i in range(600)
    ]
    w = features(spark, rows, window_days=(30,)).orderBy("window_end").first()
    inside = [r for r in rows if r[3] < day + timedelta(days=30) and r[7] >= w.comparison_magnitude_threshold]
    depths = sorted(r[6] for r in inside)
    n = len(depths)
    assert w.comparable_event_count == n
    assert w.median_depth_km == pytest.approx((depths[(n - 1) // 2] + depths[n // 2]) / 2)


def test_completeness_peak_and_minimum(spark):
    rng = random.Random(5)
    values = [rng.gauss(2.0, 0.08) for _ in range(100)] + [rng.gauss(2.8, 0.2) for _ in range(30)]
    frame = spark.createDataFrame([(v,) for v in values], "magnitude_comparable double")
    assert 1.8 <= estimate_completeness(frame).first().mc <= 2.2
    few = estimate_completeness(frame.limit(10)).first()
    assert few.mc is None and not few.sufficient_data


def test_edge_values_fall_below(spark):
    """1.4 + i * delta edges are doubles; 1.7 sits under its nominal edge."""
    import numpy as np

    values = [1.4, 1.5, 1.6, 1.7, 1.7, 1.7, 1.8, 2.0] * 10
    edges = np.arange(np.floor(1.4 / 0.1) * 0.1, np.ceil(2.0 / 0.1) * 0.1 + 0.1 + 0.05, 0.1)
    counts, _ = np.histogram(values, bins=edges)
    want = round(float(edges[int(np.argmax(counts))] + 0.05), 2)
    frame = spark.createDataFrame([(v,) for v in values], "magnitude_comparable double")
    assert estimate_completeness(frame).first().mc == want


def test_thresholds_use_floor_and_python_rounding(spark):
    rows = [event(i, datetime(1755 + i, 1, 1), 3.0 + i / 2) for i in range(3)]
    rows += [event(100 + i, datetime(2012, 1, 1) + timedelta(days=i), 2.6 + (i % 10 == 0), domain="Y") for i in range(60)]
    frame = assign_observation_epoch(spark.createDataFrame(rows, SCHEMA))
    found = {r.tectonic_domain: r for r in epoch_thresholds(frame).collect()}
    assert found["X"].comparison_threshold == 5.0 and found["X"].estimated_mc is None
    assert found["Y"].comparison_threshold == round(found["Y"].estimated_mc, 1)


def test_expanding_percentiles_match_definition(spark):
    rng = random.Random(9)
    values = [rng.randint(0, 6) for _ in range(70)]
    frame = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, window_end int, v int")
    out = running_percentiles(frame, ["k"], "v", "historical", 90, 7, 10).orderBy("window_end").collect()
    for i, row in enumerate(out):
        assert row.historical_reference_windows == i
        if i < 10:
            assert row.historical_percentile_event_rate is None
        else:
            p = sum(v <= values[i] for v in values[:i]) / i
            assert row.historical_percentile_event_rate == pytest.approx(p)
            assert 0 <= row.historical_percentile_ci_lower <= p + 1e-12
            assert p - 1e-12 <= row.historical_percentile_ci_upper <= 1
            assert 1 <= row.historical_effective_sample_size <= i
    constant = spark.createDataFrame([("a", i, 5) for i in range(30)], "k string, window_end int, v int")
    last = running_percentiles(constant, ["k"], "v", "historical", 30).orderBy(F.desc("window_end")).first()
    assert last.historical_lag1_autocorrelation is None


def test_populations_in_one_plan(spark):
    day = datetime(2020, 1, 1)
    rows = [event(i, day + timedelta(days=i)) for i in range(60)]
    rows = [r[:10] + (i % 2 == 0,) + r[11:] for i, r in enumerate(rows)]
    made = build_fingerprints(
        spark.createDataFrame(rows, SCHEMA), (30,), modes=("complete", "declustered"),
        policies=("operational", "validated"),
    )
    counts = {
        (r.catalogue_mode, r.magnitude_policy): r.event_count
        for r in made.filter("window_start = '2020-01-01'").collect()
    }
    assert counts == {
        ("complete", "operational"): 30, ("complete", "validated"): 30,
        ("declustered", "operational"): 15, ("declustered", "validated"): 15,
    }


def test_chords_rank_as_distances_and_days_stay_together(spark):
    from quakeloom.operators.fingerprints import _arc_km, _centres, _value, placed_entries
    from quakeloom.functions.scalar import haversine_km
    from quakeloom.session import in_stretches

    entries = placed_entries(spark.createDataFrame([(2, 36.5, -9.25), (2, -10.0, 179.0), (1, 12.0, None)], "kind tinyint, a double, b double"))
    window = spark.createDataFrame([(1, 30, 0, 1.0, 76.0, -20.0, 2)], "gid int, window_days int, window_index int, mag_min double, lat_sum double, lon_sum double, loc_n int")
    found = entries.withColumn("b", F.degrees(F.atan2("y", "x"))).crossJoin(_centres(window)).withColumn("value", _value())
    for row in found.select("kind", "a", "value", _arc_km(F.col("value")).alias("arc"), haversine_km(F.col("a"), F.col("b"), F.lit(38.0), F.lit(-10.0)).alias("km")).collect():
        assert row.value == row.a if row.kind == 1 else abs(row.arc - row.km) < 1e-8
    days = in_stretches(spark.range(4000).select((F.col("id") % 400).alias("day")), "day")
    spread = days.withColumn("task", F.spark_partition_id()).groupBy("day").agg(F.countDistinct("task").alias("tasks"))
    assert spread.agg(F.max("tasks")).first()[0] == 1
