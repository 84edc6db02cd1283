"""Magnitude homogenisation and the populations it defines."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeloom.fixed_values import (
    FALLBACK_EQUATION,
    FALLBACK_STATUSES,
    IDENTITY_EQUATION,
    MOMENT_MAGNITUDE_TYPES,
    NO_EQUATION,
    VALIDATED_STATUSES,
)
from quakeloom.functions.scalar import normalise_magnitude_type
from quakeloom.operators.distributed import weighted_quantiles
from quakeloom.schema import conform


@dataclass(frozen=True)
class MagnitudeRule:
    """Affine conversion of one magnitude scale."""

    source_type: str
    slope: float
    intercept: float
    uncertainty: float = 0.30
    method: str = "affine_policy"
    equation: str | None = None
    status: str = "review_required"


def load_rules(path: str | None = None) -> list[MagnitudeRule]:
    """Rules of a policy file ``{"rules": {type: {slope, intercept, ...}}}``."""
    if path is None:
        return []
    with open(path, encoding="utf-8") as handle:
        rules = json.load(handle).get("rules", {})
    return [
        MagnitudeRule(
            source_type="".join(kind.strip().upper().split(" ")) or "UNKNOWN",
            slope=float(body["slope"]),
            intercept=float(body["intercept"]),
            uncertainty=float(body.get("uncertainty", 0.30)),
            method=str(body.get("method", "affine_policy")),
            equation=body.get("equation"),
            status=str(body.get("status", "review_required")),
        )
        for kind, body in rules.items()
    ]


def homogenize_magnitudes(frame: DataFrame, rules: list[MagnitudeRule] | None = None) -> DataFrame:
    """Comparable magnitude with method, equation, uncertainty and status.

    One CASE chain over literals: the rule list is configuration, so no join.
    """
    events = conform(frame)
    value = F.col("magnitude_original_value")
    kind = normalise_magnitude_type(F.col("magnitude_original_type"))
    stated = F.col("magnitude_uncertainty")

    def at_least(floor: float | Column) -> Column:
        return F.greatest(stated, F.lit(floor) if isinstance(floor, float) else floor)

    moment = kind.isin(*MOMENT_MAGNITUDE_TYPES)
    comparable = F.when(moment, value)
    method = F.when(value.isNull(), "missing_magnitude").when(moment, "moment_magnitude_identity")
    equation = F.when(value.isNull(), NO_EQUATION).when(moment, IDENTITY_EQUATION)
    uncertainty = F.when(value.isNull(), F.lit(None).cast("double")).when(moment, at_least(0.10))
    status = F.when(value.isNull(), "missing").when(moment, "reviewed_identity")
    for rule in rules or []:
        match = kind == rule.source_type
        text = rule.equation or f"Mcomp={rule.slope:.4g}×M+{rule.intercept:.4g}"
        comparable = comparable.when(match, value * rule.slope + rule.intercept)
        method = method.when(match, rule.method)
        equation = equation.when(match, text)
        uncertainty = uncertainty.when(match, at_least(rule.uncertainty))
        status = status.when(match, rule.status)
    unknown = kind == "UNKNOWN"
    return conform(
        events.withColumns(
            {
                "magnitude_comparable": comparable.otherwise(value),
                "magnitude_homogenization_method": method.otherwise("identity_fallback_unvalidated"),
                "magnitude_conversion_equation": equation.otherwise(FALLBACK_EQUATION),
                "magnitude_conversion_uncertainty": uncertainty.otherwise(
                    at_least(F.when(unknown, 0.50).otherwise(0.35))
                ),
                "magnitude_homogenization_status": status.otherwise(
                    F.when(unknown, "unknown_scale").otherwise("review_required")
                ),
            }
        )
    )


def is_validated() -> Column:
    return F.coalesce(
        F.col("magnitude_homogenization_status").isin(*VALIDATED_STATUSES), F.lit(False)
    ) & F.col("magnitude_comparable").isNotNull()


def is_preferred() -> Column:
    return F.coalesce(F.col("is_preferred_record"), F.lit(True))


def is_background() -> Column:
    return F.coalesce(F.col("is_background_event"), F.lit(False))


def preferred_events(frame: DataFrame) -> DataFrame:
    return frame.filter(is_preferred())


def select_catalogue_mode(frame: DataFrame, mode: str) -> DataFrame:
    return frame.filter(is_background()) if mode == "declustered" else frame


def select_magnitude_policy(frame: DataFrame, policy: str) -> DataFrame:
    return frame.filter(is_validated()) if policy == "validated" else frame


def magnitude_audit_summary(frame: DataFrame) -> DataFrame:
    """Counts, exact median uncertainty and time range by type, status, method."""
    keys = [
        "magnitude_original_type",
        "magnitude_homogenization_status",
        "magnitude_homogenization_method",
    ]
    events = frame.select(
        "event_id",
        "origin_time_utc",
        "magnitude_conversion_uncertainty",
        normalise_magnitude_type(
            F.coalesce("magnitude_original_type", "magnitude_type")
        ).alias(keys[0]),
        *[F.coalesce(F.col(k), F.lit("not_processed")).alias(k) for k in keys[1:]],
    )
    counts = events.groupBy(*keys).agg(
        F.count("event_id").alias("records"),
        F.min("origin_time_utc").alias("first_time"),
        F.max("origin_time_utc").alias("last_time"),
    )
    medians = weighted_quantiles(
        events.withColumn("_one", F.lit(1)),
        keys,
        "magnitude_conversion_uncertainty",
        "_one",
        0.01,
        {"median_uncertainty": 0.5},
    )
    return counts.join(medians, keys, "left").orderBy(F.desc("records"), *keys)


def magnitude_policy_summary(frame: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    with_magnitude = F.count("magnitude_comparable")
    validated = F.count_if(is_validated())
    fallback = F.count_if(
        F.coalesce(
            F.col("magnitude_homogenization_status").isin(*FALLBACK_STATUSES), F.lit(False)
        )
    )

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return preferred_events(frame).agg(
        total.alias("preferred_events"),
        with_magnitude.alias("events_with_magnitude"),
        validated.alias("validated_events"),
        fallback.alias("fallback_events"),
        (total - with_magnitude).alias("missing_events"),
        share(validated, total).alias("validated_fraction_total"),
        share(validated, with_magnitude).alias("validated_fraction_with_magnitude"),
    )
