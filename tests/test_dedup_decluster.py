import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quakeloom.operators import dedup
from quakeloom.operators.decluster import (
    annotate_declustering, declustering_exclusion_summary, declustering_summary,
)
from quakeloom.operators.distributed import merged_components
from quakeloom.operators.magnitude import select_catalogue_mode
from tests.brute import duplicate_groups, greedy_clusters

BASE = datetime(2020, 1, 1)
SCHEMA = (
    "event_id string, source string, record_status string, origin_time_utc timestamp, "
    "latitude double, longitude double, magnitude_value double, magnitude_comparable double, "
    "quality_score double"
)


def frame(spark, rows):
    return spark.createDataFrame(
        [
            (r["id"], r.get("source", "ISC"), r.get("status", "reviewed"),
             BASE + timedelta(seconds=r["t"]), r["lat"], r["lon"], r["mag"], r["mag"], r.get("q", 0.5))
            for r in rows
        ],
        SCHEMA,
    )


def found_groups(result):
    groups = {}
    for r in result.filter("duplicate_group_id is not null").collect():
        groups.setdefault(r.duplicate_group_id, []).append(r)
    for members in groups.values():
        assert sum(m.is_preferred_record for m in members) == 1
    return {frozenset(m.event_id for m in g) for g in groups.values()}


def random_rows(seed, n, seconds, spread, lat0=38.0, lon0=-9.0, mags=(1.0, 5.0), nulls=True):
    rng = random.Random(seed)
    return [
        {
            "id": f"e{i:04d}",
            "t": rng.randint(0, seconds),
            "lat": lat0 + rng.uniform(-spread, spread),
            "lon": (lon0 + rng.uniform(-spread, spread) + 180) % 360 - 180,
            "mag": None if nulls and rng.random() < 0.1 else round(rng.uniform(*mags), 1),
        }
        for i in range(n)
    ]


@pytest.mark.parametrize(
    "rows",
    [
        random_rows(1, 250, 20_000, 0.8),
        random_rows(2, 200, 9_000, 1.5, lat0=10.0, lon0=179.9),
        random_rows(3, 150, 9_000, 3.0, lat0=86.5, lon0=20.0),
    ],
    ids=["mid", "antimeridian", "polar"],
)
def test_groups_match_pairwise_union(spark, rows):
    result = dedup.deduplicate_events(frame(spark, rows))
    assert found_groups(result) == duplicate_groups(rows)


def test_heavy_cells_are_split_not_listed(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PAIR_BUDGET", 4)
    rows = random_rows(4, 220, 1_500, 0.45, mags=(2.0, 3.5))
    result = dedup.deduplicate_events(frame(spark, rows))
    assert found_groups(result) == duplicate_groups(rows)


def test_pairs_inside_a_group_are_not_looked_at_again(spark, monkeypatch):
    rows = random_rows(5, 400, 1_500, 0.1, mags=(2.0, 2.5))
    looked_at = []
    exact = dedup.duplicate_edges

    def counted(pairs, points, grid):
        looked_at.append(pairs.count())
        return exact(pairs, points, grid)

    monkeypatch.setattr(dedup, "duplicate_edges", counted)
    result = dedup.deduplicate_events(frame(spark, rows))
    assert found_groups(result) == duplicate_groups(rows)
    assert sum(looked_at) <= 10


def test_components_of_a_path_and_of_pairs(spark):
    edges = [(i + 1, i) for i in range(60)] + [(100 + 2 * i, 101 + 2 * i) for i in range(5)]
    found = merged_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len({r.node for r in found}) == 71
    assert len({r.component for r in found if r.node <= 60}) == 1 and len({r.component for r in found}) == 6


def test_hot_copies_and_preference(spark):
    rows = [{"id": f"c{i:03d}", "t": 100, "lat": 38.0, "lon": -9.0, "mag": 3.0} for i in range(300)]
    rows[7] |= {"source": "IPMA", "status": "preliminary"}
    rows += [{"id": "far", "t": 100, "lat": 45.0, "lon": -9.0, "mag": 3.0}]
    result = dedup.deduplicate_events(frame(spark, rows)).cache()
    best = result.filter("is_preferred_record and duplicate_group_id is not null").collect()
    assert [b.event_id for b in best] == ["c007"]
    assert result.filter("event_id = 'far' and duplicate_group_id is null and is_preferred_record").count() == 1


def test_limits_are_inclusive_and_nulls_match(spark):
    rows = [
        {"id": "a", "t": 0, "lat": 0.0, "lon": 0.0, "mag": 3.0},
        {"id": "b", "t": 90, "lat": 0.0, "lon": 0.0, "mag": 3.5},
        {"id": "c", "t": 1000, "lat": 0.0, "lon": 0.0, "mag": None},
        {"id": "d", "t": 1000, "lat": 0.1, "lon": 0.0, "mag": 9.0},
        {"id": "e", "t": 2000, "lat": 0.0, "lon": 0.0, "mag": 3.0},
        {"id": "f", "t": 2091, "lat": 0.0, "lon": 0.0, "mag": 3.0},
    ]
    assert found_groups(dedup.deduplicate_events(frame(spark, rows))) == {
        frozenset("ab"), frozenset("cd"),
    }


@pytest.mark.parametrize("seed,spread,days", [(11, 0.6, 120), (12, 0.05, 20), (13, 4.0, 900)])
def test_declustering_is_the_greedy_result(spark, seed, spread, days):
    rows = random_rows(seed, 220, days * 86400, spread, mags=(1.5, 5.6), nulls=False)
    result = annotate_declustering(frame(spark, rows)).collect()
    want = greedy_clusters(rows)
    main_of = {r.cluster_id: r.event_id for r in result if r.cluster_role == "mainshock"}
    got = {r.event_id: (r.cluster_role, main_of.get(r.cluster_id)) for r in result}
    assert got == want
    order = sorted(
        (r for r in rows if want[r["id"]][0] == "mainshock"),
        key=lambda r: (-r["mag"], r["t"], r["id"]),
    )
    assert [main_of[f"SEQ-{i:06d}"] for i in range(1, len(order) + 1)] == [r["id"] for r in order]


def test_copies_share_one_claim(spark):
    rows = [{"id": f"m{i}", "t": 0, "lat": 38.0, "lon": -9.0, "mag": 5.0} for i in range(40)]
    rows += [{"id": f"a{i}", "t": 86400, "lat": 38.01, "lon": -9.0, "mag": 2.0} for i in range(40)]
    result = annotate_declustering(frame(spark, rows))
    counts = {r.cluster_role: r["count"] for r in result.groupBy("cluster_role").count().collect()}
    assert counts == {"mainshock": 1, "background": 39, "associated_event": 40}


def test_reconciliation_closes(spark):
    rows = [
        {"id": "main", "t": 0, "lat": 38.0, "lon": -9.0, "mag": 5.0},
        {"id": "after", "t": 86400, "lat": 38.02, "lon": -9.01, "mag": 2.5},
        {"id": "far", "t": 86400, "lat": 41.0, "lon": -9.0, "mag": 2.5},
    ]
    events = frame(spark, rows).unionByName(
        frame(spark, rows[:1]).withColumns(
            {"event_id": F.lit("bad"), "latitude": F.lit(None).cast("double")}
        )
    )
    result = annotate_declustering(events).cache()
    roles = {r.event_id: r.cluster_role for r in result.collect()}
    assert roles == {
        "main": "mainshock", "after": "associated_event", "far": "background", "bad": "ineligible",
    }
    kept = {r.event_id for r in select_catalogue_mode(result, "declustered").collect()}
    assert kept == {"main", "far"}
    summary = declustering_summary(result).first()
    assert summary.reconciliation_gap == 0 and summary.ineligible_events == 1
    assert [tuple(r) for r in declustering_exclusion_summary(result).collect()] == [
        ("missing_coordenadas", 1)
    ]
