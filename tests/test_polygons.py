from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quakeloom.fixed_values import NEAR_REGION_DEGREES, OUTSIDE_REGION, REGIONS, UNCLASSIFIED_REGION
from quakeloom.operators.geography import planar_area, ring_edges, with_region
from quakeloom.operators.polygons import classify_by_layer, grid_index, layer, with_layer_region
from quakeloom.plans.queries import QUERIES
from quakeloom.session import staged
from quakeloom.sources.geojson import polygons, read_polygons


def feature(name, kind, coordinates):
    return {"type": "Feature", "properties": {"name": name}, "geometry": {"type": kind, "coordinates": coordinates}}


def ring(x, y, r, corners, turn=0.0, closed=True):
    points = [[x + r * math.cos(turn + 2 * math.pi * k / corners), y + r * math.sin(turn + 2 * math.pi * k / corners)] for k in range(corners)]
    return points + points[:1] if closed else points


def points_frame(spark, points):
    return spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(points)], "id long, latitude double, longitude double").repartition(4)


def layer_of(spark, path, features):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    found = read_polygons(spark, str(path))
    return layer(found.withColumn("rank", F.col("at")))


def answers(frame):
    return {r.id: (r._region.name, r._region.confidence) for r in frame.select("id", "_region").collect()}


@pytest.mark.parametrize("size", [0.3, 2.0])
def test_equal_to_the_rule_for_two_rings(spark, tmp_path, size):
    rng = random.Random(3)
    corners = [p for _, r in REGIONS for p in r]
    points = corners + [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(corners, corners[1:], strict=False)]
    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
    points += [(rng.uniform(min(xs) - 1, max(xs) + 1), rng.uniform(min(ys) - 1, max(ys) + 1)) for _ in range(1500)]
    points += [(p[0] + rng.uniform(-0.3, 0.3), p[1] + rng.uniform(-0.3, 0.3)) for p in corners for _ in range(20)]
    points += [(float(round(x)), float(round(y))) for x, y in points[:200]] + [(None, 1.0), (1.0, None)]
    regions = layer_of(spark, tmp_path / "two.geojson", [feature(n, "Polygon", [[list(p) for p in r]]) for n, r in REGIONS])
    frame = points_frame(spark, points)
    assert answers(with_layer_region(frame, grid_index(regions, size), size)) == answers(with_region(frame))


def expected(shapes, x, y):
    """Even-odd over all rings of a shape, points on a ring inside; nearest otherwise."""
    if x is None or y is None:
        return UNCLASSIFIED_REGION
    hits, near = [], []
    for rank, (name, rings) in enumerate(shapes):
        edges = [e for r in rings for e in ring_edges(r)]
        crossed = sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges)
        if crossed % 2:
            hits.append((max(planar_area(r) for r in rings), rank, name))
        for x1, y1, x2, y2 in edges:
            dx, dy = x2 - x1, y2 - y1
            t = min(1.0, max(0.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
            near.append((math.hypot(x - (t * dx + x1), y - (t * dy + y1)), rank, name))
    if hits:
        return min(hits)[2]
    return min(near)[2] if near and min(near)[0] <= NEAR_REGION_DEGREES else OUTSIDE_REGION


def test_holes_multipolygons_and_many_shapes(spark, tmp_path):
    rng = random.Random(8)
    features = [
        feature("ring", "Polygon", [ring(0, 0, 3, 40), ring(0, 0, 1.5, 30, closed=False)]),
        feature("islands", "MultiPolygon", [[ring(6, 0, 1, 5)], [ring(9, 1, 1.2, 7), ring(9, 1, 0.4, 4)]]),
        feature("wide", "Polygon", [[[-20, -9], [25, -8.5], [25, -8], [-20, -7.9]]]),
        {"type": "Feature", "properties": {}, "geometry": None},
        feature("line", "LineString", [[0, 0], [1, 1]]),
        feature("flat", "Polygon", [[[1, 1], [2, 2]]]),
    ]
    features += [
        feature(f"s{k}", "Polygon", [ring(rng.uniform(-8, 12), rng.uniform(-6, 6), rng.uniform(0.05, 0.8), rng.randint(3, 9), rng.random())])
        for k in range(150)
    ]
    regions = layer_of(spark, tmp_path / "many.geojson", features)
    usable = [f for f in features if f["geometry"] and "olygon" in f["geometry"]["type"] and f["properties"]["name"] != "flat"]
    shapes = []
    for f in usable:
        c = f["geometry"]["coordinates"]
        rings = c if f["geometry"]["type"] == "Polygon" else [r for part in c for r in part]
        shapes.append((f["properties"]["name"], [[tuple(p) for p in r] for r in rings]))
    points = [(rng.uniform(-22, 27), rng.uniform(-10, 8)) for _ in range(600)] + [(rng.uniform(-4, 11), rng.uniform(-4, 4)) for _ in range(900)]
    found = answers(with_layer_region(points_frame(spark, points), grid_index(regions, 0.5), 0.5))
    wrong = [(p, found[i], expected(shapes, *p)) for i, p in enumerate(points) if found[i][0] != expected(shapes, *p)]
    assert not wrong and len({v for v in found.values()}) > 40


def test_single_features_empty_layers_and_plans(spark):
    texts = spark.createDataFrame([(json.dumps(feature(f"n{k}", "Polygon", [ring(k, 0, 0.4, 6)])),) for k in range(30)] + [("broken",)], "value string")
    found = polygons(texts)
    assert found.count() == 30
    frame = points_frame(spark, [(3.0, 0.0), (50.0, 50.0)])
    index = grid_index(layer(found.limit(0).withColumn("rank", F.col("at"))))
    assert {v[0] for v in answers(with_layer_region(frame, index)).values()} == {OUTSIDE_REGION}
    events = classify_by_layer(frame.withColumnRenamed("id", "event_id"), layer(found.withColumn("rank", F.col("at"))))
    assert {r.event_id: r.tectonic_domain for r in events.collect()} == {"0": "n3", "1": OUTSIDE_REGION}


def test_cells_keep_only_candidates_that_can_still_matter(spark):
    def square(r):
        return [[[-r, -r], [r, -r], [r, r], [-r, r]]]

    rows = [(f"s{i:03d}", square(1 + i / 50), i) for i in range(200)]
    regions = layer(spark.createDataFrame(rows, "name string, rings array<array<array<double>>>, rank int"))
    index = grid_index(regions, 2.0)
    assert index.fine < 2.0
    for row in index.covering.collect():
        if (row.inside or 0) > 1:
            assert all((c["area"], c["rank"], c["name"]) < tuple(row.best) for c in row.border or [])
    events = spark.createDataFrame([(0.0, 0.0), (1.5, 0.3), (4.995, 0.0), (5.1, 0.0), (9.0, 0.0)], "latitude double, longitude double")
    found = {r.latitude: tuple(r._region) for r in with_layer_region(events, index, 2.0).collect()}
    assert [found[v][0] for v in (0.0, 1.5, 5.1, 9.0)] == ["s000", "s025", "s199", OUTSIDE_REGION]


def crowd(rng, small, large):
    """Diamonds with holes over a plane of 2 x 2 degrees, small ones and, many times over, larger ones."""
    radii = [rng.uniform(0.12, 0.2) for _ in range(small)] + [rng.uniform(0.3, 0.5) for _ in range(large)]
    shapes = []
    for k, r in enumerate(radii):
        x, y = rng.uniform(0, 2), rng.uniform(0, 2)
        rings = [[(x + s, y), (x, y + s), (x - s, y), (x, y - s)] for s in (r, r / 3)] + [[(x + 2 * r, y), (x + 1.9 * r, y + 0.1 * r), (x + 1.8 * r, y)]]
        shapes.append((f"c{k:04d}", rings))
    return shapes


def test_parts_of_a_layer_give_what_all_of_it_gives(spark, monkeypatch):
    monkeypatch.setattr("quakeloom.operators.polygons.FIRST", (2000, 2000), raising=False)
    monkeypatch.setattr("quakeloom.operators.polygons.GROWTH", 2, raising=False)
    tables = []
    monkeypatch.setattr("quakeloom.operators.polygons.staged", lambda f: tables.append(staged(f)) or tables[-1])
    rng = random.Random(5)
    shapes = crowd(rng, 150, 60) + [("alone", [[(4.0, 1.0), (4.4, 1.0), (4.4, 1.5)]])]
    rows = [(n, [[list(p) for p in r] for r in rings], k) for k, (n, rings) in enumerate(shapes)]
    regions = layer(spark.createDataFrame(rows, "name string, rings array<array<array<double>>>, rank int"))
    points = [(rng.uniform(-0.8, 3.0), rng.uniform(-0.8, 2.8)) for _ in range(500)] + [(rng.uniform(0, 2), rng.uniform(0, 2)) for _ in range(400)]
    points += [(4.2, 1.1), (4.5, 1.2), (9.0, 9.0), (None, 1.0)] + [shapes[0][1][0][0], shapes[3][1][0][1]]
    events = points_frame(spark, points).withColumn("event_id", F.col("id").cast("string"))
    found = {int(r.event_id): (r.tectonic_domain, r.domain_confidence) for r in classify_by_layer(events, regions, 0.25).collect()}
    whole = answers(with_layer_region(points_frame(spark, points), grid_index(regions, 0.25), 0.25))
    assert found == whole
    assert not [(p, found[i]) for i, p in enumerate(points[:-2]) if found[i][0] != expected(shapes, *p)]
    parts = sum("turns" in t.columns for t in tables) - 1
    assert parts > 2 and len({c for _, c in found.values()}) == 5


def test_a_region_that_cannot_matter_takes_no_cells(spark, monkeypatch):
    monkeypatch.setattr("quakeloom.operators.polygons.FIRST", (130000, 130000), raising=False)
    monkeypatch.setattr("quakeloom.operators.polygons.HALVINGS", 0)
    tables = []
    monkeypatch.setattr("quakeloom.operators.polygons.staged", lambda f: tables.append(staged(f)) or tables[-1])
    rng = random.Random(6)
    points = points_frame(spark, [(rng.uniform(0.5, 1.5), rng.uniform(0.5, 1.5)) for _ in range(50)])
    taken = []
    for large in (100, 400):
        rows = [(n, [[list(p) for p in r] for r in rings], k) for k, (n, rings) in enumerate(crowd(random.Random(6), 900, large))]
        regions = layer(spark.createDataFrame(rows, "name string, rings array<array<array<double>>>, rank int"))
        tables.clear()
        classify_by_layer(points.withColumn("event_id", F.col("id").cast("string")), regions, 1 / 32).collect()
        taken.append(sum(t.count() for t in tables))
    assert taken[1] - taken[0] < 900


def test_texts_are_parsed_once_and_in_many_tasks(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame([(json.dumps(feature("n", "Polygon", [ring(0, 0, 1, 5)])),)], "value string")
    plan = layer(polygons(texts).withColumn("rank", F.col("at")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 3
    spark.range(40).selectExpr("id as c_custkey", "concat('c', id) as c_name").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")

    class Reached(Exception):
        pass

    def reached(frame):
        raise Reached(frame.rdd.getNumPartitions(), frame.count())

    monkeypatch.setattr("quakeloom.plans.queries.staged", reached)
    with pytest.raises(Reached) as found:
        QUERIES["polygon_layer"](spark, str(tmp_path))
    assert found.value.args[0] > 1 and found.value.args[1] == 40
