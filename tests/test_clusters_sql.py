"""Cluster pyramid against brute force; SQL functions against the Column functions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quakeloom.functions import scalar, sql
from quakeloom.operators import clusters, epochs, summaries


def test_cluster_pyramid_equals_brute_force(spark):
    draw = random.Random(8)
    points = [(f"e{i}", draw.choice([draw.uniform(-90, 90), 38.5]), draw.choice([draw.uniform(-180, 180), -9.1]), draw.choice([None, 1.0, 2.5])) for i in range(300)]
    points += [("edge", 90.0, 180.0, 9.0), ("low", -90.0, -180.0, 0.0), ("none", None, 1.0, 3.0), ("nan", float("nan"), 1.0, 3.0), ("e0", *points[0][1:])]
    frame = spark.createDataFrame(points, "event_id string, latitude double, longitude double, magnitude_comparable double")
    finest = 9

    def cell(lat, lon, level):
        n = 1 << level
        return min(int((lon + 180) / 360 * n), n - 1), min(int((lat + 90) / 180 * n), n - 1)

    placed = [p for p in points if p[1] is not None and p[1] == p[1]]
    want = set()
    for level in range(finest + 1):
        groups = defaultdict(list)
        for p in placed:
            groups[cell(p[1], p[2], level)].append(p)
        for members in groups.values():
            deeper = {below: {cell(p[1], p[2], below) for p in members} for below in range(level + 1, finest + 1)}
            best = min(members, key=lambda p: (p[3] is None, -(p[3] or 0), p[0]))
            want.add((
                level, len(members), round(sum(p[1] for p in members) / len(members), 6), best[3], best[0],
                len(deeper[level + 1]) if level < finest else None, next((b for b, c in deeper.items() if len(c) > 1), None),
            ))
    made = clusters.cluster_pyramid(frame, finest)
    got = [
        (r.level, r.events, round(r.latitude, 6), r.maximum_magnitude, r.strongest_event, r.children, r.expand_level) for r in made.collect()
    ]
    assert len(got) == len(want) and set(got) == want
    seen = clusters.clusters_in_view(made, 4, 30, -20, 45, 0)
    assert seen.filter("not (latitude between 30 and 45 and longitude between -20 and 0)").isEmpty() and not seen.isEmpty()
    across = clusters.clusters_in_view(made, 4, -90, 170, 90, -170).collect()
    assert all(r.longitude >= 170 or r.longitude <= -170 for r in across)


def test_cluster_pyramid_of_nothing_and_bad_levels(spark):
    empty = spark.createDataFrame([], "event_id string, latitude double, longitude double, magnitude_comparable double")
    assert clusters.cluster_pyramid(empty).isEmpty()
    with pytest.raises(ValueError):
        clusters.cluster_pyramid(empty, 3, 5)


def test_pyramid_shuffles_cells_once_per_aggregation(spark):
    points = spark.range(1000).select(
        F.col("id").cast("string").alias("event_id"), (F.rand(1) * 90).alias("latitude"), (F.rand(2) * 90).alias("longitude"), F.rand(3).alias("magnitude_comparable")
    )
    plan = clusters.cluster_pyramid(points)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_sql_functions_equal_column_functions(spark):
    sql.register(spark)
    values = [None, -1.0, 0.0, 0.5, 1.0, 3.3, 7.9]
    frame = spark.createDataFrame([(a, b, c) for a in values for b in values for c in (None, 0.2, 6.0)], "a double, b double, c double")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    lower, upper = scalar.wilson_interval(a, b)
    pairs = {
        "haversine_km(a, b, c, 1)": scalar.haversine_km(a, b, c, F.lit(1.0)),
        "seismic_energy_joule(a)": scalar.seismic_energy_joule(a),
        "spatial_window_km(a)": scalar.spatial_window_km(a),
        "temporal_window_days(a)": scalar.temporal_window_days(a),
        "wilson_interval(a, b).lower": lower,
        "wilson_interval(a, b).upper": upper,
        "effective_sample_size(a, b, c)": scalar.effective_sample_size(a, F.when(b > 0, b).otherwise(F.lit(2.0)), c),
        "brier_skill_score(a, b)": scalar.brier_skill_score(a, b),
        "activity_state(a, b, c, a * 3)": summaries.activity_state(a, b, c, a * 3),
    }
    for text, column in pairs.items():
        if text.startswith("effective"):
            text = "effective_sample_size(a, CASE WHEN b > 0 THEN b ELSE 2 END, c)"
        wrong = frame.select(F.expr(text).alias("x"), column.alias("y"))
        if "state" not in text:
            off = wrong.filter(~(F.col("x").eqNullSafe(F.col("y")) | F.coalesce(F.abs(F.col("x") - F.col("y")) <= F.abs(F.col("y")) * 1e-12, F.lit(False))))
        else:
            off = wrong.filter(~F.col("x").eqNullSafe(F.col("y")))
        assert off.isEmpty(), (text, off.head(3))
    years = spark.createDataFrame([(y,) for y in (900, 1899, 1900, 1963, 1964, 2007, 2008, 2030, None)], "y int").select(F.make_timestamp("y", F.lit(6), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("t"))
    same = years.select(
        F.expr("observation_epoch(t)").eqNullSafe(epochs.epoch_key(F.col("t"))).alias("k"),
        F.expr("observation_epoch_label(t)").eqNullSafe(epochs.epoch_label(F.col("t"))).alias("l"),
        F.expr("observation_epoch_floor(t)").eqNullSafe(epochs.epoch_floor(F.col("t"))).alias("f"),
    )
    assert same.filter("not (k and l and f)").isEmpty()


def test_table_functions_and_plans(spark):
    sql.register(spark)
    found = spark.sql("SELECT * FROM event_windows(DATE'2020-01-01', DATE'2020-01-20', 10, 4)").collect()
    assert [(r.window_index, str(r.window_start), str(r.window_end)) for r in found] == [
        (0, "2020-01-01", "2020-01-10"), (1, "2020-01-05", "2020-01-14"), (2, "2020-01-09", "2020-01-18"),
    ]
    assert spark.sql("SELECT * FROM event_windows(DATE'2020-01-01', DATE'2020-01-05', 10, 4)").isEmpty()
    assert spark.sql("SELECT * FROM observation_epochs()").count() == 4
    plan = spark.range(10).filter("haversine_km(id, id, 0, 0) < 100")._jdf.queryExecution().executedPlan().toString()
    assert "asin" in plan.lower() and "Python" not in plan
