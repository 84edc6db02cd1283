from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quakeloom.operators.fingerprints import build_fingerprints
from quakeloom.plans import incremental
from quakeloom.schema import conform

SETTINGS = incremental.Settings(window_days=(30, 90), modes=("complete", "declustered"))


def row(i, day, domain, magnitude, background=True, source="ISC"):
    return (
        f"e{i}", datetime(2006, 1, 1) + timedelta(days=day, hours=i % 20), domain, magnitude, 36 + i % 7 / 3, -9 + i % 5 / 3,
        float(i % 40), 0.5 + i % 4 / 10, background, source,
    )


def frame(spark, rows):
    columns = (
        "event_id string, origin_time_utc timestamp, tectonic_domain string, magnitude_comparable double, latitude double, "
        "longitude double, depth_km double, quality_score double, is_background_event boolean, source string"
    )
    return conform(spark.createDataFrame(rows, columns)).withColumn("is_preferred_record", F.lit(True))


def base():
    rng = random.Random(6)
    return [
        row(i, rng.randint(0, 1100), rng.choice("AAB"), None if i % 9 == 0 else round(rng.gauss(3.0, 0.7), 1), i % 4 > 0, rng.choice(["ISC", "IPMA"]))
        for i in range(900)
    ]


def rounded(made):
    names = sorted(made.columns)
    return sorted(repr([round(r[c], 7) + 0.0 if isinstance(r[c], float) else r[c] for c in names]) for r in made.collect())


def late(rows):
    return [r for r in rows if r[1] >= datetime(2008, 11, 1)]


def revised(rows):
    """Rows added at the end and inside, one revised, one moved to another day, in one of two regions."""
    rows = [r if r[0] != "e77" else (*r[:3], 5.4, *r[4:]) for r in rows]
    rows = [r if r[0] != "e50" else (r[0], r[1] + timedelta(days=200), *r[2:]) for r in rows]
    return rows + [row(2000 + k, 1101 + 3 * k, "A", 3.1) for k in range(9)] + [row(3000, 500, "A", 4.9)]


def shorter(rows):
    """The first weeks and the last months deleted."""
    return [r for r in rows if datetime(2006, 1, 20) <= r[1] < datetime(2008, 11, 1)]


def other_regions(rows):
    """A region gone, another new, and a threshold that moves."""
    rows = [r for r in rows if r[2] != "B"] + [row(4000 + k, 700 + 2 * k, "C", 2.0 + k % 4) for k in range(60)]
    return rows + [row(5000 + k, 900, "A", 4.1) for k in range(300)]


CHANGES = {f.__name__: f for f in (revised, shorter, other_regions)}


@pytest.mark.parametrize("change", CHANGES)
def test_update_equals_a_new_build(spark, tmp_path, change):
    old = base()
    new = CHANGES[change](old)
    root = str(tmp_path / "gold")
    incremental.build(frame(spark, old), root, SETTINGS)
    removed, added = [r for r in old if r not in new], [r for r in new if r not in old]
    changed = incremental.changed_days(frame(spark, removed), frame(spark, added))
    incremental.update(frame(spark, new), root, changed, SETTINGS)
    want = build_fingerprints(frame(spark, new), SETTINGS.window_days, modes=SETTINGS.modes)
    got = incremental.load(spark, root)
    assert sorted(got.columns) == sorted(want.columns)
    assert rounded(got) == rounded(want)


def test_only_partitions_with_changes_are_written(spark, tmp_path):
    root = tmp_path / "gold"
    rows = base()
    incremental.build(frame(spark, rows), str(root), SETTINGS)
    before = {p: p.stat().st_mtime_ns for p in root.rglob("*.parquet")}
    more = [row(7000, 1050, "A", 3.3)]
    new = frame(spark, rows + more)
    for _ in range(2):  # the same update again, as after a run that broke off
        incremental.update(new, str(root), incremental.changed_days(frame(spark, more)), SETTINGS)
        same = {p for p in root.rglob("*.parquet") if before.get(p) == p.stat().st_mtime_ns}
        years = {p.parent.name for p in same}
        assert {"year=2006", "year=2007"} <= years and "year=2008" not in years
    want = build_fingerprints(new, SETTINGS.window_days, modes=SETTINGS.modes)
    assert rounded(incremental.load(spark, str(root))) == rounded(want)
    incremental.update(new, str(root), incremental.changed_days(new.limit(0)), SETTINGS)
