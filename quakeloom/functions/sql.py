"""The engine's rules as SQL functions of a session.

`register` defines them by ``CREATE TEMPORARY FUNCTION ... RETURN``, so that
SQL text can use them. Their bodies are expanded into the plan: filters,
column pruning and code generation see through them, and no Python runs. They
equal the Column functions of the same name (tested).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quakeloom.fixed_values import (
    EARTH_RADIUS_KM, EPOCHS, STATE_BASELINE, STATE_CROSSING, STATE_ELEVATED, STATE_EXCEPTIONAL, STATE_MISSING, STATE_SMALL, Z_95,
)


def _epoch(pick: int, literal: str) -> str:
    years = " ".join(f"WHEN year(origin) <= {e[3]} THEN {literal.format(e[pick])}" for e in EPOCHS[:-1])
    last = literal.format(EPOCHS[-1][pick])
    return f"CASE WHEN year(origin) IS NULL THEN {last} {years} ELSE {last} END"


def _state(pair: tuple[str, str]) -> str:
    return f"named_struct('label', '{pair[0]}', 'level', '{pair[1]}')"


def _wilson(sign: str) -> str:
    z2 = f"{Z_95 * Z_95!r}D"
    share, size = "least(greatest(proportion, 0D), 1D)", "CASE WHEN n > 0 THEN n END"
    return (
        f"CASE WHEN proportion IS NOT NULL AND n > 0 THEN least(greatest(({share} + {z2} / (({size}) * 2D)) / (1D + {z2} / ({size})) {sign} "
        f"{Z_95!r}D * sqrt({share} * (1D - {share}) / ({size}) + {z2} / (({size}) * ({size}) * 4D)) / (1D + {z2} / ({size})), 0D), 1D) END"
    )


#: Signature, result and body.
SCALARS = {
    "haversine_km": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
        f"{2 * EARTH_RADIUS_KM!r}D * asin(sqrt(least(1D, power(sin((radians(lat2) - radians(lat1)) / 2D), 2D) + "
        "cos(radians(lat1)) * cos(radians(lat2)) * power(sin((radians(lon2) - radians(lon1)) / 2D), 2D))))",
    ),
    "seismic_energy_joule": ("magnitude DOUBLE", "DOUBLE", "power(10D, magnitude * 1.5D + 4.8D)"),
    "spatial_window_km": (
        "magnitude DOUBLE", "DOUBLE", "CASE WHEN magnitude IS NOT NULL THEN least(greatest(power(10D, magnitude * 0.5D - 0.75D), 12D), 180D) END",
    ),
    "temporal_window_days": (
        "magnitude DOUBLE", "DOUBLE", "CASE WHEN magnitude IS NOT NULL THEN least(greatest(power(10D, magnitude * 0.8D - 1.2D), 1D), 365D) END",
    ),
    "wilson_interval": (
        "proportion DOUBLE, n DOUBLE", "STRUCT<lower: DOUBLE, upper: DOUBLE>", f"named_struct('lower', {_wilson('-')}, 'upper', {_wilson('+')})",
    ),
    "effective_sample_size": (
        "n DOUBLE, overlap DOUBLE, rho DOUBLE", "DOUBLE",
        "CASE WHEN n > 0 THEN least(greatest(least(n, greatest(1D, n / overlap), "
        "greatest(1D, CASE WHEN rho > 0 THEN n * (1D - rho) / (1D + rho) ELSE n END)), 1D), n) ELSE 0D END",
    ),
    "brier_skill_score": ("model DOUBLE, reference DOUBLE", "DOUBLE", "CASE WHEN reference > 0 THEN 1D - model / reference END"),
    "observation_epoch": ("origin TIMESTAMP", "STRING", _epoch(0, "'{}'")),
    "observation_epoch_label": ("origin TIMESTAMP", "STRING", _epoch(1, "'{}'")),
    "observation_epoch_floor": ("origin TIMESTAMP", "DOUBLE", _epoch(4, "{}D")),
    "activity_state": (
        "percentile DOUBLE, lower DOUBLE, upper DOUBLE, effective DOUBLE", "STRUCT<label: STRING, level: STRING>",
        "CASE WHEN percentile IS NULL OR lower IS NULL OR upper IS NULL OR effective IS NULL "
        f"THEN {_state(STATE_MISSING)} WHEN effective < 5 THEN {_state(STATE_SMALL)} WHEN lower >= 0.95D THEN {_state(STATE_EXCEPTIONAL)} "
        f"WHEN lower >= 0.8D THEN {_state(STATE_ELEVATED)} WHEN upper < 0.8D THEN {_state(STATE_BASELINE)} ELSE {_state(STATE_CROSSING)} END",
    ),
}
TABLES = {
    # Windows of a width that advance by a step and end no later than the last day.
    "event_windows": (
        "first_day DATE, last_day DATE, width INT, step INT", "window_index INT, window_start DATE, window_end DATE",
        "SELECT i, date_add(first_day, i * step), date_add(first_day, i * step + width - 1) FROM explode("
        "CASE WHEN datediff(last_day, first_day) >= width - 1 THEN sequence(0, CAST((datediff(last_day, first_day) - width + 1) DIV step AS INT)) END) AS t(i)",
    ),
    "observation_epochs": (
        "", "observation_epoch STRING, label STRING, first_year INT, last_year INT, magnitude_floor DOUBLE",
        "VALUES " + ", ".join(f"('{e[0]}', '{e[1]}', {e[2]}, {e[3] if e[3] is not None else 'NULL'}, {e[4]}D)" for e in EPOCHS),
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Define all functions in the session; their names."""
    for name, (arguments, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    for name, (arguments, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns}) RETURN {body}")
    return [*SCALARS, *TABLES]
