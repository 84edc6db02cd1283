"""Replay of past states: outcomes, baselines and walk-forward scores.

Events are reduced once to daily activity per region and magnitude, with the
first instant of each day kept, which answers every interval question exactly;
from there on all tables are bounded by the calendar. Neighbours depend on the
cutoff only, so they are found once and scored under every scenario.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.fixed_values import GRID_HORIZONS, GRID_THRESHOLDS
from quakeloom.operators.epochs import epoch_key, epoch_label, epoch_start
from quakeloom.operators.magnitude import (
    preferred_events,
    select_catalogue_mode,
    select_magnitude_policy,
)
from quakeloom.operators.similarity import SimilarityResult, nearest_states
from quakeloom.operators.validation import add_expanding_isotonic_calibration
from quakeloom.session import staged

DAY_US = 86_400_000_000


@dataclass
class ReplayResult:
    scores: DataFrame
    neighbour_outcomes: DataFrame
    similarity: SimilarityResult


def scenario_table(frame: DataFrame, thresholds: Sequence[float], horizons: Sequence[int]) -> DataFrame:
    """Repeat each row for every (threshold, horizon); a literal array, no join."""
    choices = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold_magnitude"), F.lit(int(h)).alias("horizon_days"))
            for t in thresholds
            for h in horizons
        ]
    )
    return frame.select("*", F.explode(choices).alias("_s")).select(*frame.columns, "_s.*")


def daily_activity(events: DataFrame, shift_us: int = 0) -> DataFrame:
    """Per (region, epoch, day, magnitude): count, count at the first instant,
    first time and first later time. Days start ``shift_us`` after midnight."""
    ts = F.unix_micros("origin_time_utc")
    day = F.floor((ts - F.lit(shift_us)) / F.lit(DAY_US))
    later = ts > day * DAY_US + shift_us
    return (
        events.filter("origin_time_utc is not null and tectonic_domain is not null")
        .select(
            "tectonic_domain",
            epoch_key(F.col("origin_time_utc")).alias("epoch"),
            day.alias("day"),
            F.col("magnitude_comparable").alias("magnitude"),
            ts.alias("ts"),
            later.alias("later"),
        )
        .groupBy("tectonic_domain", "epoch", "day", "magnitude")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(~F.col("later")).alias("n_first"),
            F.min("ts").alias("min_ts"),
            F.min(F.when(F.col("later"), F.col("ts"))).alias("min_later"),
        )
    )


def future_outcome(asked: DataFrame, activity: DataFrame, shift_us: int = 0) -> DataFrame:
    """Add ``outcome``: does an event of at least the threshold fall in
    (start, start + horizon], and not after ``limit_us`` if given?

    ``asked`` needs ask_id, tectonic_domain, start_us (the first instant of a
    day), threshold_magnitude, horizon_days and limit_us. Each question spreads
    over its horizon + 1 days and meets them by equality.
    """
    start_day = F.floor((F.col("start_us") - F.lit(shift_us)) / F.lit(DAY_US))
    end = F.col("start_us") + F.col("horizon_days").cast("long") * DAY_US
    spread = asked.select(
        "ask_id", "tectonic_domain", "threshold_magnitude", start_day.alias("start_day"),
        F.least(end, F.col("limit_us")).alias("until"),
        F.explode(F.sequence(start_day, start_day + F.col("horizon_days"))).alias("day"),
    )
    first = F.when(F.col("a.day") == F.col("s.start_day"), F.col("a.min_later")).otherwise(
        F.col("a.min_ts")
    )
    hits = (
        spread.alias("s")
        .join(
            activity.alias("a"),
            (F.col("s.tectonic_domain") == F.col("a.tectonic_domain"))
            & (F.col("s.day") == F.col("a.day"))
            & (F.col("a.magnitude") >= F.col("s.threshold_magnitude"))
            & (first <= F.col("s.until")),
        )
        .select("s.ask_id").distinct().withColumn("_hit", F.lit(True))
    )
    return asked.join(hits, "ask_id", "left").select(
        *asked.columns, F.coalesce("_hit", F.lit(False)).alias("outcome")
    )


def baselines(asked: DataFrame, activity: DataFrame, shift_us: int = 0) -> DataFrame:
    """Empirical and Poisson baselines on the exposure of the cutoff's epoch.

    ``asked``: ask_id, tectonic_domain, cutoff (first instant of a day),
    threshold_magnitude, horizon_days.
    """
    cutoff_us = F.unix_micros("cutoff")
    keyed = asked.select(
        *asked.columns,
        epoch_key(F.col("cutoff")).alias("epoch"),
        epoch_label(F.col("cutoff")).alias("baseline_epoch"),
        F.unix_micros(epoch_start(F.col("cutoff"))).alias("epoch_us"),
        cutoff_us.alias("cutoff_us"),
        F.floor((cutoff_us - F.lit(shift_us)) / F.lit(DAY_US)).alias("cutoff_day"),
    )
    firsts = activity.groupBy("tectonic_domain", "epoch").agg(F.min("min_ts").alias("first_us"))
    keyed = keyed.join(firsts, ["tectonic_domain", "epoch"], "left")
    known = F.coalesce(F.col("first_us") <= F.col("cutoff_us"), F.lit(False))
    training = F.greatest(F.col("epoch_us"), F.floor(F.col("first_us") / F.lit(DAY_US)) * DAY_US)
    exposure = F.when(
        known, F.greatest(F.lit(0.0), (F.col("cutoff_us") - training) / F.lit(float(DAY_US)))
    ).otherwise(0.0)
    keyed = keyed.withColumn("exposure_days", exposure).withColumn(
        "windows", F.floor(F.col("exposure_days") / F.col("horizon_days"))
    )
    keyed = staged(
        keyed.withColumn(
            "start_day", F.col("cutoff_day") - F.col("windows") * F.col("horizon_days")
        ).withColumn(
            "training_start",
            F.timestamp_micros(F.when(known, training).otherwise(F.col("cutoff_us"))),
        )
    )
    on_cutoff = F.col("a.day") == F.col("k.cutoff_day")
    joined = keyed.alias("k").join(
        activity.alias("a"),
        (F.col("k.tectonic_domain") == F.col("a.tectonic_domain"))
        & (F.col("k.epoch") == F.col("a.epoch"))
        & (F.col("a.day") <= F.col("k.cutoff_day"))
        & (F.col("a.magnitude") >= F.col("k.threshold_magnitude")),
    )
    offset = F.col("a.day") - F.col("k.start_day")
    counted = F.when(on_cutoff, F.col("a.n_first")).otherwise(F.col("a.n"))
    valid = (
        F.when(on_cutoff, F.col("a.n_first") > 0)
        .when(offset == 0, F.col("a.min_later").isNotNull())
        .otherwise(offset > 0)
    )
    bins = F.when(
        valid & (F.col("k.windows") > 0),
        F.least(F.col("k.windows") - 1, F.floor(offset / F.col("k.horizon_days"))),
    )
    # bins first, so that each (question, bin) is one row before the count
    per_bin = joined.select("k.ask_id", bins.alias("bin"), counted.alias("n")).groupBy(
        "ask_id", "bin"
    ).agg(F.sum("n").alias("n"))
    totals = per_bin.groupBy("ask_id").agg(
        F.sum("n").alias("_events"), F.count("bin").alias("_positive")
    )
    rate = F.when(F.col("exposure_days") > 0, F.col("events") / F.col("exposure_days")).otherwise(0.0)
    return (
        keyed.join(totals, "ask_id", "left")
        .withColumn("events", F.coalesce("_events", F.lit(0)))
        .withColumn("positive", F.coalesce("_positive", F.lit(0)))
        .select(
            *asked.columns,
            F.col("epoch").alias("baseline_epoch_key"),
            "baseline_epoch",
            "training_start",
            F.col("events").alias("baseline_event_count"),
            F.col("exposure_days").alias("baseline_exposure_days"),
            F.col("windows").alias("empirical_window_count"),
            F.col("positive").alias("empirical_positive_windows"),
            F.when(F.col("windows") > 0, F.col("positive") / F.col("windows"))
            .otherwise(0.0).alias("historical_rate_probability"),
            rate.alias("poisson_lambda_per_day"),
            (1.0 - F.exp(-rate * F.col("horizon_days"))).alias("poisson_probability"),
        )
    )


def clean_events(events: DataFrame, catalogue_mode: str, magnitude_policy: str) -> DataFrame:
    return select_magnitude_policy(
        select_catalogue_mode(preferred_events(events), catalogue_mode), magnitude_policy
    )


def one_population(fingerprints: DataFrame, catalogue_mode: str, magnitude_policy: str) -> DataFrame:
    if "catalogue_mode" in fingerprints.columns:
        fingerprints = fingerprints.filter(F.col("catalogue_mode") == catalogue_mode)
    if "magnitude_policy" in fingerprints.columns:
        fingerprints = fingerprints.filter(F.col("magnitude_policy") == magnitude_policy)
    return fingerprints


def replay_cutoffs(
    events: DataFrame,
    fingerprints: DataFrame,
    cutoffs: DataFrame,
    window_days: int = 90,
    thresholds: Sequence[float] = (4.0,),
    horizons: Sequence[int] = (30,),
    catalogue_mode: str = "complete",
    magnitude_policy: str = "operational",
    family_method: str = "fixed",
    shift_us: int = 0,
    **similarity_options,
) -> ReplayResult:
    """Score every cutoff under every scenario.

    ``cutoffs``: query_id, tectonic_domain, cutoff; all cutoffs share the time
    of day ``shift_us``. Cutoffs without enough history drop out.
    """
    clean = clean_events(events, catalogue_mode, magnitude_policy)
    states = one_population(fingerprints, catalogue_mode, magnitude_policy)
    found = nearest_states(
        states,
        cutoffs.withColumnRenamed("cutoff", "target_end"),
        window_days,
        family_method=family_method,
        **similarity_options,
    )
    activity = staged(daily_activity(clean))
    shifted = activity if shift_us == 0 else staged(daily_activity(clean, shift_us))
    questions = scenario_table(
        found.neighbours.join(cutoffs.select("query_id", "cutoff"), "query_id"), thresholds, horizons
    ).select(
        "query_id", "tectonic_domain", "cutoff", "threshold_magnitude", "horizon_days",
        "analogue_rank", "family_id", "family_start", "family_end", "episode_id",
        "window_start", "window_end", "similarity", "comparability_score", "family_method",
        F.unix_micros("window_end").alias("start_us"),
        F.unix_micros("cutoff").alias("limit_us"),
        F.concat_ws("/", "query_id", "analogue_rank", "threshold_magnitude", "horizon_days").alias("ask_id"),
    )
    outcomes = staged(
        future_outcome(questions, activity)
        .withColumnRenamed("outcome", "future_event")
        .drop("ask_id", "start_us", "limit_us")
    )
    weight = F.col("similarity") * F.col("comparability_score")
    keys = ["query_id", "threshold_magnitude", "horizon_days"]
    analogue = outcomes.groupBy(*keys).agg(
        F.try_divide(F.sum(weight * F.col("future_event").cast("int")), F.sum(weight)).alias(
            "analogue_probability"
        )
    )
    asked = scenario_table(
        cutoffs.join(found.neighbours.select("query_id").distinct(), "query_id"), thresholds, horizons
    ).select(
        "*",
        F.concat_ws("/", "query_id", "threshold_magnitude", "horizon_days").alias("ask_id"),
    )
    observed = future_outcome(
        asked.select(
            "*", F.unix_micros("cutoff").alias("start_us"),
            F.lit(None).cast("long").alias("limit_us"),
        ),
        shifted,
        shift_us,
    ).select("ask_id", F.col("outcome").alias("observed_outcome"))
    actual = F.col("observed_outcome").cast("double")

    def brier(p: str) -> Column:
        return (F.col(p) - actual) * (F.col(p) - actual)

    scores = (
        baselines(asked, shifted, shift_us)
        .join(observed, "ask_id")
        .join(analogue, keys)
        .select(
            "query_id", "tectonic_domain", "cutoff",
            "analogue_probability", "historical_rate_probability", "poisson_probability",
            "observed_outcome",
            brier("analogue_probability").alias("brier_analogue"),
            brier("historical_rate_probability").alias("brier_historical"),
            brier("poisson_probability").alias("brier_poisson"),
            "baseline_epoch", "baseline_event_count", "baseline_exposure_days",
            "threshold_magnitude", "horizon_days",
            F.lit(catalogue_mode).alias("catalogue_mode"),
            F.lit(magnitude_policy).alias("magnitude_policy"),
            F.lit(family_method).alias("family_method"),
        )
    )
    return ReplayResult(staged(scores), outcomes, found)


def walk_forward_cutoffs(
    fingerprints: DataFrame, window_days: int, step_days: int, horizons: Sequence[int],
    start_date: str | None = None,
) -> DataFrame:
    """Cutoffs per region from the 40 % point of its windows (or a start date)
    to the last window minus the shortest horizon; ``last_end`` limits longer
    horizons."""
    series = Window.partitionBy("tectonic_domain")
    placed = fingerprints.filter(F.col("window_days") == window_days).select(
        "tectonic_domain",
        "window_end",
        (F.row_number().over(series.orderBy("window_end")) - 1).alias("_i"),
        F.count(F.lit(1)).over(series).alias("_n"),
    )
    start = (
        F.to_timestamp(F.lit(start_date))
        if start_date
        else F.max(F.when(F.col("_i") == F.floor((F.col("_n") - 1) * F.lit(0.4)), F.col("window_end")))
    )
    spans = placed.groupBy("tectonic_domain").agg(
        start.alias("first"), F.max("window_end").alias("last_end")
    )
    latest = F.col("last_end") - F.expr(f"interval {min(horizons)} days")
    return (
        spans.filter(F.col("first") <= latest)
        .select(
            "tectonic_domain", "last_end",
            F.explode(F.sequence(F.col("first"), latest, F.expr(f"interval {int(step_days)} days")))
            .alias("cutoff"),
        )
        .select(
            F.xxhash64("tectonic_domain", "cutoff").alias("query_id"),
            "tectonic_domain", "cutoff", "last_end",
        )
    )


def walk_forward_grid(
    events: DataFrame,
    fingerprints: DataFrame,
    window_days: int = 90,
    thresholds: Sequence[float] = GRID_THRESHOLDS,
    horizons: Sequence[int] = GRID_HORIZONS,
    frequency_days: int = 60,
    family_method: str = "adaptive",
    catalogue_mode: str = "complete",
    magnitude_policy: str = "operational",
    start_date: str | None = None,
    domain: str | None = None,
    calibrate: bool = True,
) -> DataFrame:
    """Walk-forward scores for every region (or one) and scenario."""
    states = one_population(fingerprints, catalogue_mode, magnitude_policy)
    if domain is not None:
        states = states.filter(F.col("tectonic_domain") == domain)
    cutoffs = staged(
        walk_forward_cutoffs(states, window_days, frequency_days, horizons, start_date)
    )
    result = replay_cutoffs(
        events, states, cutoffs.drop("last_end"), window_days, thresholds, horizons,
        catalogue_mode, magnitude_policy, family_method,
        shift_us=_time_of_day_us(start_date),
        family_gap_days=max(window_days * 8, 365),
    )
    scores = (
        result.scores.join(cutoffs.select("query_id", "last_end"), "query_id")
        .filter(F.expr("cutoff <= last_end - make_dt_interval(horizon_days)"))
        .drop("query_id", "last_end")
    )
    if not calibrate:
        return scores
    return add_expanding_isotonic_calibration(
        scores,
        keys=("tectonic_domain", "catalogue_mode", "magnitude_policy", "threshold_magnitude", "horizon_days"),
    )


def _time_of_day_us(start_date: str | None) -> int:
    if not start_date or len(start_date) <= 10:
        return 0
    clock = start_date[11:].replace("Z", "").split("+")[0]
    hours, minutes, seconds = (clock.split(":") + ["0", "0"])[:3]
    return int((int(hours) * 3600 + int(minutes) * 60 + float(seconds)) * 1_000_000)
