from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains
from pyspark.sql.types import StructType

from quakeloom.schema import EVENT_SCHEMA, conform
from quakeloom.sources import ranges, snapshots

T0 = datetime(1531, 1, 26)


def catalogue(spark, n=400):
    rng = random.Random(4)
    rows = [
        (str(i), T0 + timedelta(days=450 * i, microseconds=i), rng.uniform(-90, 90), rng.uniform(-180, 180),
         None if i % 7 == 0 else float(i % 90), None if i % 5 == 0 else (i % 80) / 10, ["a|b", 'say "x"', "", None, "two\nlines", " pad "][i % 6])
        for i in range(n)
    ]
    schema = "event_id string, origin_time_utc timestamp, latitude double, longitude double, depth_km double, magnitude_value double, location_text string"
    return conform(spark.createDataFrame(rows, schema))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("snapshots"))
    snapshots.write_snapshots(catalogue(spark), path, rows_per_file=25)
    return path


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


CONDITIONS = [
    "origin_time_utc >= timestamp'1700-01-01' and origin_time_utc < timestamp'1790-06-01'",
    "latitude between -20 and 40 and longitude > 0 and magnitude_value >= 4.5",
    "depth_km in (3, 80) or magnitude_value > 7",
    "event_id in ('7', '9', 'none') and depth_km is not null",
    "magnitude_value is null and location_text = 'a|b'",
    "origin_time_utc > timestamp'3000-01-01'",
    "location_text like '%x%' and not (latitude < 0)",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_conditions_give_what_a_filter_gives(spark, folder, condition):
    assert same(snapshots.load_snapshots(spark, folder, condition), catalogue(spark).filter(condition))


def test_whole_table_round_trip_and_reuse(spark, folder):
    everything = snapshots.load_snapshots(spark, folder)
    assert everything.filter("latitude > 80").count() == catalogue(spark).filter("latitude > 80").count()
    assert same(everything, catalogue(spark))
    bound = snapshots.load_snapshots(spark, folder, "latitude > 0")
    fewer = bound.filter("longitude > 0").count()
    assert fewer == catalogue(spark).filter("latitude > 0 and longitude > 0").count()
    assert bound.count() == catalogue(spark).filter("latitude > 0").count()


def test_nothing_is_left_to_filter(spark, folder):
    def filters(condition):
        plan = snapshots.load_snapshots(spark, folder, condition)._jdf.queryExecution().executedPlan().toString()
        return re.findall(r"\bFilter \(.*", plan)

    assert filters(CONDITIONS[0]) == filters(CONDITIONS[1]) == []
    assert filters(CONDITIONS[2])  # an "or" stays with Spark


def test_zone_map_prunes_files(folder):
    def files(*filters):
        reader = snapshots.SnapshotReader(StructType.fromDDL(EVENT_SCHEMA), folder, 1 << 30, True)
        left = list(reader.pushFilters(list(filters)))
        return sum(len(p.files) for p in reader.partitions()), left

    time = ("origin_time_utc",)
    every, _ = files()
    few, left = files(GreaterThanOrEqual(time, datetime(1700, 1, 1)), LessThan(time, datetime(1750, 1, 1)))
    assert every >= 16 and 1 <= few <= 5 and left == []
    assert files(EqualTo(("latitude",), 1e9))[0] == 0
    assert files(In(("magnitude_value",), (1e9, -5.0)))[0] == 0
    kept = StringContains(("location_text",), "x")
    assert files(kept) == (every, [kept])
    small = snapshots.SnapshotReader(StructType.fromDDL(EVENT_SCHEMA), folder, 1, True)
    assert len(small.partitions()) == every


# -- ranges ------------------------------------------------------------------------------------------


def table(spark, rows):
    day = lambda d: None if d is None else datetime(2000, 1, 1) + timedelta(days=d)
    return spark.createDataFrame(
        [(k, day(a), day(b)) for k, a, b in rows], f"feed string, {ranges.START} timestamp, {ranges.END} timestamp"
    )


def days_of(rows):
    return {(k, d) for k, a, b in rows if a is not None and b is not None for d in range(a, b)}


def as_days(frame):
    found = [(r.feed, (r[ranges.START] - datetime(2000, 1, 1)).days, (r[ranges.END] - datetime(2000, 1, 1)).days) for r in frame.collect()]
    return found


def disjoint(found):
    return all(
        k1 != k2 or e1 < s2 for (k1, _, e1), (k2, s2, _) in zip(sorted(found), sorted(found)[1:], strict=False)
    )


@pytest.mark.parametrize("seed", range(3))
def test_set_algebra(spark, seed):
    rng = random.Random(seed)
    draw = lambda n: [(rng.choice("ab"), s := rng.randint(0, 80), s + rng.randint(-2, 12)) for _ in range(n)]
    left, right = draw(25) + [("a", 3, None)], draw(25) + [("c", 1, 4)]
    l, r = table(spark, left), table(spark, right)
    a, b = days_of(left), days_of(right)
    for function, want in ((ranges.union, a | b), (ranges.intersection, a & b), (ranges.difference, a - b)):
        found = as_days(function(l, r, ["feed"]))
        assert days_of(found) == want and disjoint(found)


def test_manifest_and_gaps(spark):
    asked = table(spark, [("a", 0, 10), ("a", 5, 15), ("a", 20, 30), ("a", 20, 30), ("b", 0, 4), ("c", 0, 5), ("a", 9, 9)])
    read = table(spark, [("a", 0, 7), ("a", 6, 12), ("a", 29, 40), ("b", -3, 9), ("z", 0, 99)])
    entries = ranges.manifest_entries(asked, read, ["feed"])
    got = {(r.feed, (r[ranges.START] - datetime(2000, 1, 1)).days): (r.status, r.held_seconds / 86400) for r in entries.collect()}
    assert got == {
        ("a", 0): ("complete", 10), ("a", 5): ("partial", 7), ("a", 20): ("partial", 1), ("b", 0): ("complete", 4), ("c", 0): ("failed", 0),
    }
    left = as_days(ranges.gaps(asked, entries, ["feed"]))
    assert sorted(left) == [("a", 10, 15), ("a", 20, 30), ("c", 0, 5)]
    done = ranges.union(read, ranges.gaps(asked, entries, ["feed"]), ["feed"])
    again = ranges.manifest_entries(asked, done, ["feed"])
    assert {r.status for r in again.collect()} == {"complete"}
    assert ranges.gaps(asked, again, ["feed"]).count() == 0
    assert ranges.manifest_entries(asked.limit(0), read, ["feed"]).count() == 0
    whole = ranges.difference(asked.select(ranges.START, ranges.END), read.limit(0).select(ranges.START, ranges.END))
    assert whole.count() == 2


def test_tasks_on_ranges_follow_their_number(spark, monkeypatch):
    from quakeloom import session

    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    rng = random.Random(5)
    draw = lambda n: [(rng.choice("abcdefgh"), s := rng.randint(0, 400), s + rng.randint(1, 9)) for _ in range(n)]
    left, right = draw(200), draw(200) + [("a", 7, 9)] * 50
    gone = ranges.difference(table(spark, left), table(spark, right), ["feed"])
    assert gone.rdd.getNumPartitions() == 45
    assert days_of(as_days(gone)) == days_of(left) - days_of(right)


def test_manifest_sweeps_once_without_a_join(spark, capsys):
    asked, read = table(spark, [("a", 0, 10), (None, 0, 3)]), table(spark, [("a", 0, 7), (None, 0, 3)])
    entries = ranges.manifest_entries(asked, read, ["feed"])
    entries.explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and plan.count("Exchange") <= 2
    assert {(r.feed, r.status) for r in entries.collect()} == {("a", "partial"), (None, "failed")}
