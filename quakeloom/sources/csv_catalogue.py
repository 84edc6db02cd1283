"""Historical CSV catalogues with caller-supplied column names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.functions.scalar import parse_datetime, to_float
from quakeloom.schema import EVENT_COLUMNS, conform, stable_event_id
from quakeloom.sources.fdsn import fields

# --- Fixed values: default column names -------------------------------------
DEFAULT_COLUMNS = {
    "source_event_id": "event_id",
    "origin_time_utc": "origin_time",
    "latitude": "latitude",
    "longitude": "longitude",
    "depth_km": "depth_km",
    "magnitude_value": "magnitude",
    "magnitude_type": "magnitude_type",
    "intensity_max": "intensity",
    "location_text": "location",
}


def read_historical(
    spark: SparkSession, path: str, column_mapping: Mapping[str, str] | None = None
) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return normalise(raw.withColumn("source_file", F.col("_metadata.file_path")), column_mapping)


def normalise(raw: DataFrame, column_mapping: Mapping[str, str] | None = None) -> DataFrame:
    names = {**DEFAULT_COLUMNS, **(column_mapping or {})}

    def field(name: str) -> Column:
        column = names[name]
        return F.col(f"`{column}`") if column in raw.columns else F.lit(None).cast("string")

    parsed = raw.select(
        F.coalesce(field("source_event_id"), F.sha1(F.concat_ws("|", *raw.columns))).alias(
            "source_event_id"
        ),
        parse_datetime(field("origin_time_utc")).alias("origin_time_utc"),
        *[to_float(field(n)).alias(n) for n in ("latitude", "longitude", "depth_km", "magnitude_value")],
        *[field(n).cast("string").alias(n) for n in ("magnitude_type", "intensity_max", "location_text")],
        (F.col("source_file") if "source_file" in raw.columns else F.lit(None).cast("string")).alias(
            "source_file"
        ),
    ).filter("origin_time_utc is not null and latitude is not null and longitude is not null")
    return conform(
        parsed.select(
            "*",
            stable_event_id(
                F.lit("IPMA_HISTORICAL"), F.col("source_event_id"), F.col("origin_time_utc"),
                F.col("latitude"), F.col("longitude"),
            ).alias("event_id"),
            F.lit("IPMA_HISTORICAL").alias("source"),
            F.col("magnitude_value").alias("magnitude_comparable"),
            F.lit("medium").alias("historical_quality"),
            F.lit(0.72).alias("quality_score"),
            F.lit("historical").alias("record_status"),
            F.current_timestamp().alias("ingested_at_utc"),
        )
    )


def read_harmonised(spark: SparkSession, path: str) -> DataFrame:
    """Every CSV file below ``path`` that is a catalogue in the harmonised schema.

    Such a file has an event id column (``event_id``, or with a suffix after
    it) and ``origin_time_utc``; files named as normalised ones are left out, as
    are others. Each file's own header counts. A quoted field may hold commas,
    but no line breaks.
    """
    files = (
        spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv").load(path)
        .select("value", F.col("_metadata.file_path").alias("source_file"), F.lower("_metadata.file_name").alias("_name"))
        .filter(~F.col("_name").rlike("normali[sz]ed"))
    )
    lines = F.filter(F.split(F.regexp_replace("value", "^\\uFEFF", ""), "\\r?\\n"), lambda x: F.trim(x) != "")
    names = F.transform(fields(F.get("_lines", F.lit(0)), F.lit(",")), lambda c: F.when(c.startswith("event_id_"), "event_id").otherwise(c))
    headed = files.select("source_file", lines.alias("_lines")).select("source_file", "_lines", names.alias("_names")).filter(
        F.array_contains("_names", "event_id") & F.array_contains("_names", "origin_time_utc")
    )
    rows = headed.select("source_file", "_names", F.explode(F.slice("_lines", 2, F.size("_lines"))).alias("_line")).select(
        "source_file", "_names", fields(F.col("_line"), F.lit(",")).alias("_values")
    )

    def value(name: str) -> Column:
        given = F.get("_values", F.array_position("_names", name).cast("int") - 1)
        return F.nullif(given, F.lit(""))

    own = [c for c in EVENT_COLUMNS if c not in ("source_file", "origin_time_utc")]
    return conform(rows.select(
        *[value(c).alias(c) for c in own],
        parse_datetime(value("origin_time_utc")).alias("origin_time_utc"),
        F.coalesce(value("source_file"), "source_file").alias("source_file"),
    ))
