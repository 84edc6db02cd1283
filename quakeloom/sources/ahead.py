"""Historical catalogue service: GeoJSON features to harmonised events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeloom.fixed_values import AHEAD_ALIASES
from quakeloom.functions.scalar import to_float
from quakeloom.schema import conform, stable_event_id
from quakeloom.sources.ipma import FEATURE, pick


def normalise(snapshots: DataFrame, source_url: str | None = None) -> DataFrame:
    features = snapshots.select(
        "source_file",
        F.posexplode(F.from_json("payload", f"struct<features:array<{FEATURE}>>")["features"]).alias(
            "position", "f"
        ),
    )
    p = F.col("f.properties")
    field = {name: pick(p, aliases) for name, aliases in AHEAD_ALIASES.items()}
    at = F.col("f.geometry.coordinates")
    lat, lon = to_float(field["latitude"]), to_float(field["longitude"])
    incomplete = (lat.isNull() | lon.isNull()) & (F.size(at) >= 2)

    def part(name: str, default: int) -> Column:
        value = F.floor(to_float(field[name])).cast("int")
        return F.coalesce(F.nullif(value, F.lit(0)) if default else value, F.lit(default))

    origin = F.try_make_timestamp(
        F.floor(to_float(field["year"])).cast("int"), part("month", 1), part("day", 1),
        part("hour", 0), part("minute", 0), F.lit(0).cast("decimal(16,6)"),
    )
    parsed = features.select(
        "source_file",
        F.coalesce(field["id"], F.col("position").cast("string")).alias("source_event_id"),
        origin.alias("origin_time_utc"),
        F.when(incomplete, F.get(at, F.lit(1))).otherwise(lat).alias("latitude"),
        F.when(incomplete, F.get(at, F.lit(0))).otherwise(lon).alias("longitude"),
        to_float(field["depth"]).alias("depth_km"),
        to_float(field["magnitude"]).alias("magnitude_value"),
        field["intensity"].alias("intensity_max"),
        field["location"].alias("location_text"),
        F.greatest(
            to_float(field["latitude_uncertainty"]), to_float(field["longitude_uncertainty"])
        ).alias("location_uncertainty_km"),
        to_float(field["magnitude_uncertainty"]).alias("magnitude_uncertainty"),
    ).filter("latitude is not null and longitude is not null")
    sized = F.col("magnitude_value").isNotNull()
    return conform(
        parsed.select(
            "*",
            stable_event_id(
                F.lit("AHEAD"), F.col("source_event_id"), F.col("origin_time_utc"),
                F.col("latitude"), F.col("longitude"),
            ).alias("event_id"),
            F.lit("AHEAD").alias("source"),
            F.when(sized, "Mw").alias("magnitude_type"),
            F.col("magnitude_value").alias("magnitude_comparable"),
            F.lit("medium").alias("historical_quality"),
            F.when(sized, 0.72).otherwise(0.58).alias("quality_score"),
            F.lit("historical").alias("record_status"),
            F.lit(source_url).cast("string").alias("source_url"),
            F.current_timestamp().alias("ingested_at_utc"),
        )
    )
