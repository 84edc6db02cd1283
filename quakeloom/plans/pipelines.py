"""End-to-end plans: raw snapshots to catalogue to fingerprints to scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from quakeloom.operators.decluster import DeclusterParameters, annotate_declustering
from quakeloom.operators.dedup import deduplicate_events
from quakeloom.operators.fingerprints import MODES, POLICIES, build_fingerprints
from quakeloom.operators.geography import classify_events
from quakeloom.operators.magnitude import MagnitudeRule, homogenize_magnitudes
from quakeloom.sources.bronze import load_bronze
from quakeloom.sources.synthetic import demo_events
from quakeloom.sources.tables import load_silver, save_gold, save_silver


def harmonise(
    events: DataFrame,
    rules: list[MagnitudeRule] | None = None,
    time_seconds: float = 90,
    distance_km: float = 35,
    magnitude_delta: float = 0.6,
    parameters: DeclusterParameters | None = None,
    regions: Sequence | None = None,
) -> DataFrame:
    """Raw events to a catalogue: magnitudes, duplicates, regions, sequences.

    Duplicates are grouped on the stated magnitude, before regions are known;
    sequences use preferred records only and ignore regions.
    """
    grouped = deduplicate_events(
        homogenize_magnitudes(events, rules), time_seconds, distance_km, magnitude_delta
    )
    placed = classify_events(grouped, regions) if regions is not None else classify_events(grouped)
    return annotate_declustering(placed, parameters)


def build_silver(spark: SparkSession, bronze: str, silver: str, **options) -> None:
    save_silver(harmonise(load_bronze(spark, bronze), **options), silver)


def build_gold(
    events: DataFrame,
    gold: str,
    modes: Sequence[str] = MODES,
    policies: Sequence[str] = POLICIES,
    window_days: Sequence[int] = (30, 90, 365),
    step_days: int = 7,
) -> None:
    """All asked populations in one plan."""
    save_gold(
        build_fingerprints(events, window_days, step_days, modes=modes, policies=policies), gold
    )


def bootstrap_demo(spark: SparkSession, silver: str, gold: str) -> None:
    """Demonstration catalogue: no grouping, regions given, a 30-day hop."""
    save_silver(annotate_declustering(homogenize_magnitudes(demo_events(spark))), silver)
    build_gold(load_silver(spark, silver), gold, step_days=30)
