"""IPMA area feed: JSON payloads to harmonised events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeloom.fixed_values import IPMA_ALIASES
from quakeloom.functions.scalar import first_present, parse_datetime, to_bool, to_float
from quakeloom.schema import conform, stable_event_id

RECORD = "map<string,string>"
FEATURE = "struct<properties:map<string,string>,geometry:struct<coordinates:array<double>>>"
ENVELOPE = (
    f"struct<data:array<{RECORD}>,events:array<{RECORD}>,"
    f"features:array<{FEATURE}>,observations:array<{RECORD}>>"
)


def pick(record: Column, names: Sequence[str]) -> Column:
    """First alias that is present and not empty."""
    return first_present(*[record[n] for n in names])


def extract_records(payload: Column) -> Column:
    """The list of records of a payload: a bare list, or the first list among
    data / events / features / observations; feature coordinates fill absent
    latitude and longitude."""
    envelope = F.from_json(payload, ENVELOPE)
    coordinates = lambda f: f["geometry"]["coordinates"]

    def lifted(feature: Column) -> Column:
        own = F.coalesce(feature["properties"], F.create_map().cast(RECORD))
        at = coordinates(feature)
        placed = F.map_filter(
            F.map_from_arrays(
                F.array(F.lit("longitude"), F.lit("latitude")),
                F.array(F.get(at, F.lit(0)).cast("string"), F.get(at, F.lit(1)).cast("string")),
            ),
            lambda k, v: v.isNotNull() & ~F.map_contains_key(own, k),
        )
        return F.map_concat(own, placed)

    listed = F.from_json(payload, f"array<{RECORD}>")
    return F.when(F.ltrim(payload).startswith("["), listed).otherwise(
        F.coalesce(
            envelope["data"],
            envelope["events"],
            F.transform(envelope["features"], lifted),
            envelope["observations"],
        )
    )


def normalise(snapshots: DataFrame, source_url: str | None = None) -> DataFrame:
    """``snapshots``: payload and source_file; one row per usable record."""
    records = snapshots.select(
        "source_file", F.explode(extract_records(F.col("payload"))).alias("r")
    )
    r = F.col("r")
    field = {name: pick(r, aliases) for name, aliases in IPMA_ALIASES.items()}
    parsed = records.select(
        "source_file",
        F.coalesce(field["id"], F.lit("")).alias("raw_id"),
        parse_datetime(field["time"], field["date"], field["hour"]).alias("origin_time_utc"),
        to_float(field["latitude"]).alias("latitude"),
        to_float(field["longitude"]).alias("longitude"),
        to_float(field["depth"]).alias("depth_km"),
        to_float(field["magnitude"]).alias("magnitude_value"),
        F.coalesce(field["magnitude_type"], F.lit("ML")).alias("magnitude_type"),
        field["intensity"].alias("intensity_max"),
        field["location"].alias("location_text"),
        F.coalesce(
            to_bool(field["felt"]), F.when(field["intensity"] != "0", F.lit(True))
        ).alias("felt"),
    ).filter("origin_time_utc is not null and latitude is not null and longitude is not null")
    ident = stable_event_id(
        F.lit("IPMA"), F.col("raw_id"), F.col("origin_time_utc"), F.col("latitude"), F.col("longitude")
    )
    measured = F.col("magnitude_value").isNotNull() & F.col("depth_km").isNotNull()
    return conform(
        parsed.select(
            "*",
            ident.alias("event_id"),
            F.coalesce(F.nullif("raw_id", F.lit("")), ident).alias("source_event_id"),
            F.lit("IPMA").alias("source"),
            F.col("magnitude_value").alias("magnitude_comparable"),
            F.lit("high").alias("historical_quality"),
            F.when(measured, 0.92).otherwise(0.82).alias("quality_score"),
            F.lit("preliminary").alias("record_status"),
            F.lit(source_url).cast("string").alias("source_url"),
            F.current_timestamp().alias("ingested_at_utc"),
        )
    )
