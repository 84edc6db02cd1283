"""Derived tables: versioned Parquet sinks with metadata, and their readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.fixed_values import SOURCE_PRIORITY
from quakeloom.operators.fingerprints import POPULATION
from quakeloom.schema import conform
from quakeloom.sources import versions

#: Sources whose rows are counted while the catalogue is written.
COUNTED = tuple(SOURCE_PRIORITY)


def save(frame: DataFrame, path: str, partition_by: Sequence[str] = (), csv_path: str | None = None) -> None:
    """Overwrite a dataset through Spark's commit protocol; optionally also CSV."""
    frame.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    if csv_path:
        frame.sparkSession.read.parquet(path).write.mode("overwrite").option("header", True).csv(csv_path)


def metadata(frame: DataFrame) -> DataFrame:
    """Row count, columns and per-source counts, one row."""
    counted = frame.groupBy(
        F.coalesce(F.col("source"), F.lit("<NA>")).alias("s") if "source" in frame.columns
        else F.lit("all").alias("s")
    ).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("source_counts"),
    ).select(
        F.current_timestamp().alias("generated_at_utc"), "row_count",
        F.array(*[F.lit(c) for c in frame.columns]).alias("columns"), "source_counts",
    )


def save_silver(frame: DataFrame, path: str, csv_path: str | None = None) -> None:
    """A new version of the catalogue; rows a source are counted as it is written."""
    spark = frame.sparkSession
    made = versions.entry(spark, path, versions.commit(conform(frame), path, count_by="source", expected=COUNTED))
    if csv_path:
        load_silver(spark, path).write.mode("overwrite").option("header", True).csv(csv_path)
    row = (made["rows"], [f["name"] for f in made["schema"]["fields"]], made["counts"])
    spark.createDataFrame([row], "row_count long, columns array<string>, source_counts map<string,long>").select(
        F.to_timestamp(F.lit(made["written_at"])).alias("generated_at_utc"), "*"
    ).write.mode("overwrite").json(f"{path}.metadata")


def load_silver(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return conform(versions.read(spark, path, version))


def save_gold(frame: DataFrame, path: str) -> None:
    """Populations are partitions: a new version replaces those that were built."""
    versions.commit(frame, path, POPULATION, replace="partitions")


def load_gold(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Fingerprints with the types they were written with."""
    return versions.read(spark, path, version)


def assert_not_stale_demo(events: DataFrame, has_real_snapshots: bool) -> DataFrame:
    """Refuse a catalogue of demonstration rows when real snapshots exist."""
    if has_real_snapshots:
        real = events.filter(F.coalesce(F.col("source"), F.lit("")) != "DEMO")
        if real.isEmpty() and not events.isEmpty():
            raise RuntimeError("the stored catalogue is the demonstration one; rebuild it first")
    return events
