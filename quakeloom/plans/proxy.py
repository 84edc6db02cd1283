"""The driver's generic tables seen as event catalogues.

Integer arithmetic only, so that any SQL engine derives the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.schema import EVENT_COLUMNS, EVENT_FIELDS
from quakeloom.session import use_utc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{folder}/{name}.parquet")


def _as_events(frame: DataFrame, columns: dict) -> DataFrame:
    kinds = dict(EVENT_FIELDS)
    return frame.select(
        *[
            (columns[c] if c in columns else F.lit(None)).cast(kinds[c]).alias(c)
            for c in EVENT_COLUMNS
        ]
    )


def orders_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a multi-year catalogue with five regions; dates move ten years
    on so that they span two observation epochs."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    magnitude = F.floor(F.col("o_totalprice") / 10000) / F.lit(10.0)
    return _as_events(
        table(spark, folder, "orders"),
        {
            "event_id": key.cast("string"),
            "source_event_id": key.cast("string"),
            "source": F.when(F.col("o_orderstatus") == "F", "ISC")
            .when(F.col("o_orderstatus") == "O", "IPMA")
            .otherwise("OTHER"),
            "origin_time_utc": F.col("o_orderdate").cast("timestamp") + F.expr("interval 3653 days"),
            "latitude": F.lit(36) + (cust % 400) / F.lit(100.0),
            "longitude": F.lit(-12) + (key % 500) / F.lit(100.0),
            "depth_km": F.when(key % 11 != 0, cust % 60),
            "magnitude_value": magnitude,
            "magnitude_original_value": magnitude,
            "magnitude_comparable": magnitude,
            "magnitude_type": F.when(key % 3 == 0, "Mw").when(key % 3 == 1, "ML"),
            "magnitude_original_type": F.when(key % 3 == 0, "Mw").when(key % 3 == 1, "ML"),
            "magnitude_homogenization_status": F.when(key % 3 == 0, "reviewed_identity")
            .when(key % 3 == 1, "review_required")
            .otherwise("unknown_scale"),
            "magnitude_conversion_uncertainty": (key % 7) / F.lit(20.0),
            "location_text": F.col("o_orderpriority"),
            "tectonic_domain": F.col("o_orderpriority"),
            "quality_score": (key % 4) / F.lit(4.0),
            "record_status": F.when(key % 2 == 0, "reviewed").otherwise("preliminary"),
            "is_preferred_record": key % 13 != 0,
            "is_background_event": key % 5 != 0,
        },
    )


def stream_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream as a dense catalogue at second scale."""
    user, ident = F.col("user_id"), F.col("event_id")
    magnitude = F.floor(F.col("value")) / F.lit(100.0)
    return _as_events(
        table(spark, folder, "events"),
        {
            "event_id": ident.cast("string"),
            "source_event_id": ident.cast("string"),
            "source": F.when(ident % 3 == 0, "IPMA").when(ident % 3 == 1, "ISC").otherwise("AHEAD"),
            "origin_time_utc": F.col("ts").cast("timestamp"),
            "latitude": F.lit(36) + (user % 40) / F.lit(10.0),
            "longitude": F.lit(-12) + (user % 50) / F.lit(10.0),
            "depth_km": F.when(ident % 11 != 0, user % 60),
            "magnitude_value": F.when(ident % 17 != 0, magnitude),
            "magnitude_original_value": F.when(ident % 17 != 0, magnitude),
            "magnitude_comparable": F.when(ident % 17 != 0, magnitude),
            "magnitude_type": F.when(ident % 3 == 0, "Mw").when(ident % 3 == 1, "ML"),
            "magnitude_original_type": F.when(ident % 3 == 0, "Mw").when(ident % 3 == 1, "ML"),
            "location_text": F.col("event_type"),
            "tectonic_domain": F.col("event_type"),
            "quality_score": (ident % 4) / F.lit(4.0),
            "record_status": F.when(ident % 2 == 0, "reviewed").otherwise("preliminary"),
        },
    )
