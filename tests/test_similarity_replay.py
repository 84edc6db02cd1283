import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakeloom.operators.replay import baselines, daily_activity, future_outcome, replay_cutoffs, walk_forward_grid
from quakeloom.operators.similarity import adaptive_families, nearest_states
from quakeloom.operators.validation import (
    add_expanding_isotonic_calibration, average_precision, calibration_status, model_rows,
    precision_recall_points, summarise_backtest_grid,
)
from quakeloom.plans.queries import shown_skill
from tests.brute import WEIGHTS, distances, isotonic_prediction, regimes, separate

DAY0 = datetime(2000, 1, 1)


def states(seed=1, n=160, step=20, w=90):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        end = DAY0 + timedelta(days=i * step)
        row = {
            "tectonic_domain": "X", "window_days": w, "window_end": end,
            "window_start": end - timedelta(days=w - 1), "comparison_epoch": "modern_network",
            "comparison_epoch_label": "m", "comparison_magnitude_threshold": 3.0,
            "catalogue_mode": "complete", "magnitude_policy": "operational",
        }
        for name in WEIGHTS:
            row[name] = rng.gauss(0, 1) + math.sin(i / 9)
        row["comparable_event_count"] = rng.randint(1, 40)
        row["days_since_previous_m3"] = None
        row["data_quality_score"] = 0.8
        if i % 7 == 0:
            row["catalogue_completeness_mc"] = None
            row["spatial_dispersion_km"] = None
        for c in ("magnitude_coverage_ratio", "depth_coverage_ratio", "location_coverage_ratio"):
            row[c] = rng.random()
        for c in ("source_share_ipma", "source_share_isc", "source_share_ahead", "source_share_other"):
            row[c] = rng.random()
        rows.append(row)
    return pd.DataFrame(rows)


def to_spark(spark, frame):
    kinds = {"window_days": "int", "comparable_event_count": "long"}
    fields = ", ".join(
        f"{c} " + (
            kinds.get(c)
            or ("timestamp" if c in ("window_start", "window_end") else "double" if frame[c].dtype == float or c == "days_since_previous_m3" else "string")
        )
        for c in frame.columns
    )
    rows = [tuple(None if (isinstance(v, float) and v != v) else v for v in r) for r in frame.astype(object).itertuples(index=False)]
    rows = [tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in rows]
    return spark.createDataFrame(rows, fields)


@pytest.fixture(scope="module")
def pool(spark):
    return states(), to_spark(spark, states()).cache()


def ask(spark):
    return spark.sql("select 1L as query_id, 'X' as tectonic_domain, cast(null as timestamp) as target_end")


@pytest.mark.parametrize("metric", ["euclidean", "mahalanobis"])
def test_fixed_families_match_numpy(spark, pool, metric):
    frame, data = pool
    found = nearest_states(data, ask(spark), 90, k=4, family_gap_days=200, metric=metric)
    got = found.neighbours.orderBy("analogue_rank").toPandas()
    target = frame.iloc[-1]
    history = frame[frame.window_end <= target.window_end - timedelta(days=365)].copy()
    history["raw"] = distances(history, target, metric)
    by_end = dict(zip(history.window_end, history.raw))
    for r in got.itertuples():
        assert r.raw_distance == pytest.approx(by_end[r.window_end], rel=1e-6)
        assert r.adjusted_distance == pytest.approx(r.raw_distance / max(r.comparability_score, 0.2))
    every = found.pools.first()
    assert every.status == "ok" and every.pool_size == len(history)
    # days_since (all NULL) and quality (constant) are not usable
    assert every.usable_features == len(WEIGHTS) - 2
    shares = found.feature_differences.groupBy("analogue_rank").agg(F.sum("contribution_pct").alias("s"))
    assert all(r.s == pytest.approx(100) for r in shares.collect())
    starts, ends = got.family_start.tolist(), got.family_end.tolist()
    for i in range(len(got)):
        for j in range(i):
            assert starts[i] > ends[j] + timedelta(days=90) or ends[i] < starts[j] - timedelta(days=90)
    assert got.adjusted_distance.is_monotonic_increasing


def test_greedy_choice_matches_sequential(spark, pool):
    frame, data = pool
    found = nearest_states(data, ask(spark), 90, k=5, family_gap_days=60, family_buffer_days=30)
    got = found.neighbours.orderBy("analogue_rank").toPandas()
    wide = nearest_states(data, ask(spark), 90, k=1000, family_gap_days=60, family_buffer_days=0)
    assert wide.pools.first().status == "history_too_short"
    target = frame.iloc[-1]
    history = frame[frame.window_end <= target.window_end - timedelta(days=365)].copy()
    history["raw"] = distances(history, target)
    # adjusted distances of every window come from asking for each alone
    from quakeloom.operators.similarity import comparability
    t = data.filter(F.col("window_end") == F.lit(target.window_end.to_pydatetime())).alias("t")
    h = data.filter(F.col("window_end") <= F.lit((target.window_end - timedelta(days=365)).to_pydatetime())).alias("f")
    scores = comparability(lambda c: F.col(f"f.{c}"), lambda c: F.col(f"t.{c}"))
    comp = dict(
        (r[0], r[1])
        for r in h.join(t, F.lit(True)).select("f.window_end", scores["comparability_score"]).collect()
    )
    half = math.ceil(60 / 2)
    cands = []
    days = [(e - DAY0).days for e in history.window_end]
    for end, raw in zip(history.window_end, history.raw):
        d = (end - DAY0).days
        near = [x for x in days if abs(x - d) <= half]
        cands.append((raw / max(comp[end.to_pydatetime()], 0.2), d, min(near) - 89, max(near)))
    want = [c[1] for c in separate(cands, 5, 30)]
    assert [(e - DAY0).days for e in got.window_end] == want


def test_scaled_pairs_equal_the_long_form(spark, pool):
    from quakeloom.operators.similarity import scaled_features, scaled_pairs

    frame, data = pool
    names = list(WEIGHTS)
    target = data.filter(F.col("window_end") == F.lit(frame.window_end.iloc[-1].to_pydatetime()))
    both = data.alias("f").join(target.alias("t"), F.lit(True)).select(
        # Two queries, one with too few rows for any feature.
        F.when(F.col("f.window_end") < F.lit(frame.window_end.iloc[2].to_pydatetime()), 2).otherwise(1).cast("long").alias("query_id"),
        F.unix_seconds("f.window_end").alias("row"),
        *[F.col(f"f.{n}").cast("double").alias(f"x{i}") for i, n in enumerate(names)],
        *[F.col(f"t.{n}").cast("double").alias(f"t{i}") for i, n in enumerate(names)],
    )
    entries = F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"x{i}").alias("value"), F.col(f"t{i}").alias("target"))
        for i, n in enumerate(names)
    ])
    long = both.select("query_id", "row", F.explode(entries).alias("e")).select("query_id", "row", "e.*")
    want = {(r.query_id, r.row, r.feature): (r.z, r.target_z) for r in scaled_features(long, ["query_id"]).collect()}
    wide = scaled_pairs(both, names).collect()
    got = {
        (r.query_id, r.row, n): (z, t)
        for r in wide for n, z, t, w in zip(names, r._z, r._target_z, r._weights) if w is not None
    }
    assert got == want and len(got) > 0
    for r in wide:
        assert r._used == (0 if r.query_id == 2 else len(WEIGHTS) - 2) == sum(z is not None for z in r._z)
        assert r._pool == (2 if r.query_id == 2 else len(frame) - 2)
        assert r._used == 0 or sum(w for w in r._weights if w is not None) == pytest.approx(r._used)
    assert scaled_pairs(both.limit(0), names).count() == 0


def test_adaptive_regimes_match_sequential(spark, pool):
    frame, data = pool
    pooled = data.select(
        F.lit(1).cast("long").alias("query_id"), F.unix_seconds("window_end").alias("row"), "*",
        (F.unix_seconds("window_end") % 977 / 10.0).alias("adjusted_distance"),
    )
    got = adaptive_families(pooled, 300, 3.5).orderBy("adaptive_regime_id").toPandas()
    names = ["comparable_event_rate_per_30d", "maximum_magnitude", "log10_total_energy_j", "spatial_dispersion_km"]
    rows = [((e - DAY0).days, *v) for e, *v in frame[["window_end", *names]].itertuples(index=False)]
    ids = regimes(rows, 300)
    sizes = pd.Series(ids).value_counts().sort_index()
    assert got.family_window_count.tolist() == sizes.tolist()
    ends = frame.window_end.groupby(pd.Series(ids)).max().tolist()
    assert got.family_end.tolist() == ends


def test_exclusion_and_epoch(spark, pool):
    _, data = pool
    other = data.withColumn(
        "comparison_epoch", F.when(F.col("window_end") < "2003-01-01", "early_instrumental").otherwise("modern_network")
    )
    found = nearest_states(other, ask(spark), 90, k=3)
    got = found.neighbours.toPandas()
    assert got.window_end.min() >= pd.Timestamp("2003-01-01")
    assert got.window_end.max() <= found.targets.first().window_end - timedelta(days=365)


EVENTS = "event_id string, tectonic_domain string, origin_time_utc timestamp, magnitude_comparable double, is_preferred_record boolean"


def catalogue(spark, seed=4, n=900, days=3300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = DAY0 + timedelta(days=rng.randint(0, days))
        if rng.random() < 0.7:
            at += timedelta(seconds=rng.randint(0, 86399))
        rows.append((str(i), "X", at, None if rng.random() < 0.05 else round(rng.uniform(2.5, 5.0), 1), True))
    return rows, spark.createDataFrame(rows, EVENTS)


def brute_outcome(rows, start, h, thr, limit=None):
    end = start + timedelta(days=h)
    end = min(end, limit) if limit else end
    return any(start < t <= end and m is not None and m >= thr for _, _, t, m, _ in rows)


def brute_baseline(rows, cutoff, h, thr):
    start = datetime(1964, 1, 1) if cutoff.year < 2008 else datetime(2008, 1, 1)
    past = [(t, m) for _, _, t, m, _ in rows if start <= t <= cutoff]
    if not past:
        return 0, 0.0, 0, 0
    first = min(t for t, _ in past)
    begun = max(start, datetime(first.year, first.month, first.day))
    exposure = (cutoff - begun).total_seconds() / 86400
    windows = int(exposure // h)
    hits = [t for t, m in past if m is not None and m >= thr]
    zero = cutoff - timedelta(days=windows * h)
    offsets = [(t - zero).total_seconds() / 86400 for t in hits]
    bins = {min(windows - 1, int(o // h)) for o in offsets if 0 < o <= windows * h} if windows else set()
    return len(hits), exposure, windows, len(bins)


@pytest.mark.parametrize("hour", [0, 6])
def test_outcomes_and_baselines_match_definition(spark, hour):
    rows, events = catalogue(spark)
    shift = hour * 3_600_000_000
    cutoffs = [DAY0 + timedelta(days=d, hours=hour) for d in range(5, 3300, 61)]
    asked = spark.createDataFrame(
        [(f"{i}/{t}/{h}", "X", c, t, h) for i, c in enumerate(cutoffs) for t in (4.0, 4.9) for h in (7, 30)],
        "ask_id string, tectonic_domain string, cutoff timestamp, threshold_magnitude double, horizon_days int",
    )
    activity = daily_activity(events, shift)
    for limit_days in (None, 12):
        limited = asked.select(
            "*", F.unix_micros("cutoff").alias("start_us"),
            (F.lit(None).cast("long") if limit_days is None
             else F.unix_micros("cutoff") + limit_days * 86_400_000_000).alias("limit_us"),
        )
        for r in future_outcome(limited, activity, shift).collect():
            limit = r.cutoff + timedelta(days=limit_days) if limit_days else None
            assert r.outcome == brute_outcome(rows, r.cutoff, r.horizon_days, r.threshold_magnitude, limit)
    for r in baselines(asked, activity, shift).collect():
        n, exposure, windows, positive = brute_baseline(rows, r.cutoff, r.horizon_days, r.threshold_magnitude)
        assert (r.baseline_event_count, r.empirical_window_count, r.empirical_positive_windows) == (n, windows, positive)
        assert r.baseline_exposure_days == pytest.approx(exposure)


def test_replay_scores_follow_from_neighbours(spark, pool):
    frame, data = pool
    rows, events = catalogue(spark)
    cutoffs = spark.createDataFrame(
        [(1, "X", DAY0 + timedelta(days=2500)), (2, "X", DAY0 + timedelta(days=100))],
        "query_id long, tectonic_domain string, cutoff timestamp",
    )
    result = replay_cutoffs(events, data, cutoffs, 90, (4.0, 4.9), (7, 30), family_gap_days=200)
    scores = result.scores.collect()
    assert {s.query_id for s in scores} == {1} and len(scores) == 4  # the early cutoff has no history
    outcomes = result.neighbour_outcomes.toPandas()
    for s in scores:
        mine = outcomes[(outcomes.threshold_magnitude == s.threshold_magnitude) & (outcomes.horizon_days == s.horizon_days)]
        for o in mine.itertuples():
            assert o.future_event == brute_outcome(
                rows, o.window_end.to_pydatetime(), s.horizon_days, s.threshold_magnitude, s.cutoff)
        w = mine.similarity * mine.comparability_score
        p = (w * mine.future_event).sum() / w.sum()
        assert s.analogue_probability == pytest.approx(p)
        seen = brute_outcome(rows, s.cutoff, s.horizon_days, s.threshold_magnitude)
        assert s.observed_outcome == seen and s.brier_analogue == pytest.approx((p - seen) ** 2)
        assert outcomes.window_end.max() <= pd.Timestamp(s.cutoff)


def test_walk_forward_calendar(spark, pool):
    frame, data = pool
    _, events = catalogue(spark)
    scores = walk_forward_grid(events, data, thresholds=(4.0,), horizons=(7, 90), frequency_days=120, family_method="fixed").toPandas()
    ends = sorted(frame.window_end)
    first, last = ends[int((len(ends) - 1) * 0.4)], ends[-1]
    for h in (7, 90):
        want = list(pd.date_range(first, last - timedelta(days=h), freq="120D"))
        assert sorted(scores[scores.horizon_days == h].cutoff) == want
    assert scores.analogue_probability.between(0, 1).all()


def test_calibration_is_expanding_isotonic(spark):
    rng = random.Random(8)
    rows = [(DAY0 + timedelta(days=i), rng.choice([0.1, 0.2, 0.4, 0.55, 0.8, rng.random()]), rng.random() < 0.4) for i in range(60)]
    frame = spark.createDataFrame(rows, "cutoff timestamp, analogue_probability double, observed_outcome boolean")
    out = add_expanding_isotonic_calibration(frame, 30, ()).orderBy("cutoff").collect()
    for i, r in enumerate(out):
        if i < 30:
            assert r.analogue_calibrated_probability is None and r.brier_analogue_calibrated is None
        else:
            x, y = [p for _, p, _ in rows[:i]], [float(o) for _, _, o in rows[:i]]
            assert r.analogue_calibrated_probability == pytest.approx(isotonic_prediction(x, y, rows[i][1]))


@pytest.mark.parametrize("kind", ["rising", "falling", "ties", "equal outcomes"])
def test_growing_fit_equals_a_fit_from_scratch(kind):
    from quakeloom.operators.validation import GrowingIsotonic

    rng = np.random.default_rng(len(kind))
    x = rng.integers(0, 9, 30) / 8.0 if kind == "ties" else rng.random(30)
    chance = {"falling": 1 - x, "equal outcomes": np.ones(30)}.get(kind, x)
    y = (rng.random(30) <= chance).astype(float)
    fit = GrowingIsotonic()
    for i in range(30):
        if i:
            for asked in (x[i], -1.0, 2.0, x[0]):
                assert fit.predict(asked) == pytest.approx(isotonic_prediction(list(x[:i]), list(y[:i]), asked), abs=1e-12)
        fit.add(x[i], y[i])


def test_summary_and_status(spark):
    p = np.linspace(0.05, 0.95, 80)
    rows = [
        (DAY0 + timedelta(days=i), float(v), 0.3, 0.2, bool(v > 0.55), float((v - (v > 0.55)) ** 2),
         float((0.3 - (v > 0.55)) ** 2), float((0.2 - (v > 0.55)) ** 2), 4.0, 30, "complete", "operational")
        for i, v in enumerate(p)
    ]
    frame = spark.createDataFrame(
        rows,
        "cutoff timestamp, analogue_probability double, historical_rate_probability double, poisson_probability double, "
        "observed_outcome boolean, brier_analogue double, brier_historical double, brier_poisson double, "
        "threshold_magnitude double, horizon_days int, catalogue_mode string, magnitude_policy string",
    )
    out = {r.model: r for r in summarise_backtest_grid(frame).collect()}
    raw = out["Famílias — score bruto"]
    assert raw.valid_cutoffs == 80 and raw.average_precision == pytest.approx(1.0)
    assert raw.bss_vs_empirical > 0 and raw.total_cutoffs == 80
    assert out["Frequência empírica"].bss_vs_empirical == pytest.approx(0.0)
    points = precision_recall_points(model_rows(frame))
    assert average_precision(points).filter("model = 'Famílias — score bruto'").first().average_precision == pytest.approx(1)
    assert calibration_status(add_expanding_isotonic_calibration(frame)).first().calibration_status in ("experimental", "adequate")


def test_shown_skill_of_a_reference_that_is_never_wrong(spark):
    frame = spark.createDataFrame(
        [(0.04, None, -5000.0), (0.0, None, None), (0.04, 0.25, -3.0)],
        "mean_brier double, bss_vs_empirical double, bss_vs_poisson double",
    )
    shown = [(r.bss_vs_empirical, r.bss_vs_poisson) for r in shown_skill(frame).collect()]
    assert shown == [(-1000.0, -1000.0), (None, None), (0.25, -3.0)]
