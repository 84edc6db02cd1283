"""Raw snapshot zone: whole JSON files, routed by path, parsed on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.schema import union_events
from quakeloom.sources import ahead, csv_catalogue, fdsn, ipma


def read_snapshots(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One row per snapshot file: payload, source_file, modified."""
    reader = spark.readStream if streaming else spark.read
    return (
        reader.format("text")
        .option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .load(path)
        .select(
            F.col("value").alias("payload"),
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
    )


def _routed(snapshots: DataFrame, folder: str) -> DataFrame:
    # files that are not JSON are skipped, like unreadable ones
    return snapshots.filter(F.lower("source_file").contains(f"/{folder}/")).filter(
        F.try_parse_json("payload").isNotNull()
    )


def normalise_snapshots(snapshots: DataFrame) -> DataFrame:
    """Events of all three feeds; each file is routed by its folder."""
    return union_events(
        [
            ipma.normalise(_routed(snapshots, "ipma")),
            ahead.normalise(_routed(snapshots, "ahead")),
            fdsn.normalise_snapshots(_routed(snapshots, "isc")),
        ]
    )


def load_bronze(spark: SparkSession, path: str, csv_paths: list[str] | None = None) -> DataFrame:
    """Everything under a bronze folder, its harmonised CSVs too, plus historical CSVs if named."""
    frames = [normalise_snapshots(read_snapshots(spark, path)), csv_catalogue.read_harmonised(spark, path)]
    frames += [csv_catalogue.read_historical(spark, p) for p in csv_paths or []]
    return union_events(frames, spark)


def snapshot_counts(snapshots: DataFrame) -> DataFrame:
    """Files and latest modification per feed."""
    path = F.lower("source_file")
    source = F.when(path.contains("/ipma/"), "IPMA").when(path.contains("/ahead/"), "AHEAD").when(
        path.contains("/isc/"), "ISC"
    )
    return (
        snapshots.select(source.alias("source"), "modified")
        .filter("source is not null")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("snapshot_count"), F.max("modified").alias("last_snapshot"))
    )


def verify_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Compare each snapshot with its ``.sha256`` sidecar."""
    def files(glob: str) -> DataFrame:
        return (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob)
            .load(path)
            .select(F.regexp_replace("path", r"\.(json|sha256)$", "").alias("base"), "content")
        )

    digests = files("*.sha256").select(
        "base", F.trim(F.regexp_replace(F.col("content").cast("string"), "\\s+", "")).alias("expected")
    )
    return (
        files("*.json").select("base", F.sha2("content", 256).alias("actual"))
        .join(digests, "base", "left")
        .select("base", "actual", "expected", (F.col("actual") == F.col("expected")).alias("matches"))
    )
