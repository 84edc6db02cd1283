"""Scalar building blocks as Column expressions; everything stays in codegen."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeloom.fixed_values import EARTH_RADIUS_KM, FALSE_TOKENS, TRUE_TOKENS, Z_95


def clip(column: Column, low: float | Column, high: float | Column) -> Column:
    """NULL-preserving clip (``least``/``greatest`` alone would skip NULLs)."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(column.isNotNull(), F.least(F.greatest(column, low), high))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    dphi = F.radians(lat2) - F.radians(lat1)
    dlam = F.radians(lon2) - F.radians(lon1)
    sin_phi, sin_lam = F.sin(dphi / 2), F.sin(dlam / 2)
    a = sin_phi * sin_phi + F.cos(phi1) * F.cos(phi2) * sin_lam * sin_lam
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def seismic_energy_joule(magnitude: Column) -> Column:
    return F.pow(F.lit(10.0), magnitude * 1.5 + 4.8)


def spatial_window_km(magnitude: Column, low: float = 12.0, high: float = 180.0) -> Column:
    return clip(F.pow(F.lit(10.0), magnitude * 0.5 - 0.75), low, high)


def temporal_window_days(magnitude: Column, low: float = 1.0, high: float = 365.0) -> Column:
    return clip(F.pow(F.lit(10.0), magnitude * 0.8 - 1.2), low, high)


def wilson_interval(proportion: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson score bounds for a real-valued sample size; NULL when n <= 0."""
    p = clip(proportion, 0.0, 1.0)
    size = F.when(n > 0, n.cast("double"))
    z2 = z * z
    denominator = 1.0 + F.lit(z2) / size
    centre = (p + F.lit(z2) / (size * 2.0)) / denominator
    margin = (
        F.lit(z)
        * F.sqrt(p * (1.0 - p) / size + F.lit(z2) / (size * size * 4.0))
        / denominator
    )
    return clip(centre - margin, 0.0, 1.0), clip(centre + margin, 0.0, 1.0)


def effective_sample_size(n: Column, overlap: Column, rho: Column) -> Column:
    """Smallest of n, n/overlap and the autocorrelation bound, kept in [1, n]."""
    size = n.cast("double")
    bound = F.when(rho > 0, size * (1.0 - rho) / (1.0 + rho)).otherwise(size)
    value = F.least(
        size, F.greatest(F.lit(1.0), size / overlap), F.greatest(F.lit(1.0), bound)
    )
    return F.when(n > 0, F.least(F.greatest(value, F.lit(1.0)), size)).otherwise(F.lit(0.0))


def overlap_factor(window_days: Column | int, step_days: int) -> Column:
    days = window_days if isinstance(window_days, Column) else F.lit(int(window_days))
    return F.greatest(F.lit(1), F.ceil(days / F.lit(max(int(step_days), 1))).cast("int"))


def brier_skill_score(model: Column, reference: Column) -> Column:
    return F.when(reference > 0, 1.0 - model / reference)


def first_present(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def to_float(column: Column) -> Column:
    """Numeric cast that accepts a decimal comma."""
    return F.replace(column.cast("string"), F.lit(","), F.lit(".")).try_cast("double")


def to_bool(column: Column) -> Column:
    token = F.lower(F.trim(column.cast("string")))
    return F.when(token.isin(*TRUE_TOKENS), True).when(token.isin(*FALSE_TOKENS), False)


# ISO texts go through a plain cast; these are tried after it, in order.
DATE_FORMATS = (
    "yyyy/M/d[ HH:mm[:ss]]",
    "M/d/yyyy[ HH:mm[:ss]]",
    "M-d-yyyy[ HH:mm[:ss]]",
    "d/M/yyyy[ HH:mm[:ss]]",
    "d-M-yyyy[ HH:mm[:ss]]",
)


def parse_datetime(value: Column, date: Column | None = None, time: Column | None = None) -> Column:
    """Month-first, then day-first, then date + time; NULL when nothing fits."""

    def parsed(text: Column) -> Column:
        text = F.trim(text.cast("string"))
        return F.coalesce(
            text.try_cast("timestamp"), *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]
        )

    result = parsed(value)
    if date is not None:
        clock = F.coalesce(time, F.lit("")) if time is not None else F.lit("")
        result = F.coalesce(result, parsed(F.concat_ws(" ", date.cast("string"), clock)))
    return result


def normalise_magnitude_type(column: Column) -> Column:
    text = F.replace(F.upper(F.trim(column)), F.lit(" "), F.lit(""))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("UNKNOWN"))


def extract_year(column: Column) -> Column:
    """Year of a timestamp, or the leading signed four digits of a text."""
    text = F.regexp_extract(F.trim(column.cast("string")), r"^([+-]?\d{4})", 1)
    return F.nullif(text, F.lit("")).try_cast("int")


@F.pandas_udf(T.DoubleType())
def round_half_even_1(values: pd.Series) -> pd.Series:
    """Round the exact binary value to one decimal; the JVM rounds the shortest
    decimal text instead, which differs for numbers such as 1.45. Used only on
    the per-(region, epoch) threshold table."""
    return values.map(lambda v: None if v is None or v != v else round(float(v), 1))


def cube_xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Cartesian position in km. A chord never exceeds its arc, so points
    within r km on the sphere lie within r km on every axis; no pole or
    antimeridian case remains."""
    phi, lam = F.radians(lat), F.radians(lon)
    return (
        F.cos(phi) * F.cos(lam) * EARTH_RADIUS_KM,
        F.cos(phi) * F.sin(lam) * EARTH_RADIUS_KM,
        F.sin(phi) * EARTH_RADIUS_KM,
    )


def weighted_geometric_mean(parts: Sequence[tuple[Column, float]], floor: float = 0.05) -> Column:
    total = None
    for column, weight in parts:
        term = F.ln(clip(column, floor, 1.0)) * weight
        total = term if total is None else total + term
    return F.exp(total)
