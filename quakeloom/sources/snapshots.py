"""Text snapshots of events with a zone map, read with predicates pushed down.

A snapshot is a delimited text file of some range of events. Beside the files
lies a zone map, a Parquet table with the least and greatest time, coordinates
and magnitude of every file. Comparisons in a query reach the source: it asks
the zone map which files can hold a match, splits only those among tasks, and
applies the comparisons to the lines it reads, so that Spark has nothing left
to filter. Time, a box and a least magnitude are what the remote services take
as well.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
    LessThan, LessThanOrEqual,
)
from pyspark.sql.types import DoubleType, StructType, TimestampType

from quakeloom.schema import EVENT_SCHEMA
from quakeloom.session import ship_package

FORMAT = "event_snapshots"
FILES, ZONES = "files", "zones"
ZONE_COLUMNS = ("origin_time_utc", "latitude", "longitude", "depth_km", "magnitude_value")
SEPARATOR = "|"
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
COMPARED = {
    EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge,
    LessThan: operator.lt, LessThanOrEqual: operator.le,
}


def write_snapshots(
    events: DataFrame, path: str, rows_per_file: int = 1_000_000, zone_columns: Sequence[str] = ZONE_COLUMNS
) -> None:
    """Events in time order as files of at most ``rows_per_file`` lines under ``path``/files, and
    their zone map under ``path``/zones.

    The order makes the files' ranges disjoint, which is what lets a range skip files.
    """
    ordered = events.repartitionByRange(F.col(zone_columns[0])).sortWithinPartitions(zone_columns[0])
    ordered.write.format("csv").options(maxRecordsPerFile=rows_per_file, **_text_options()).save(f"{path}/{FILES}")
    update_zones(events.sparkSession, path, events.schema, zone_columns)


def update_zones(spark: SparkSession, path: str, schema: StructType, zone_columns: Sequence[str] = ZONE_COLUMNS) -> None:
    """Make the zone map anew from the files under ``path``."""
    # Times are kept as microseconds, which every reader of Parquet takes for the same.
    plain = {c: F.unix_micros(c) if isinstance(schema[c].dataType, TimestampType) else F.col(c) for c in zone_columns}
    ranges = [f(plain[c]).alias(f"{n}_{c}") for c in zone_columns for n, f in (("min", F.min), ("max", F.max))]
    spark.read.format("csv").options(**_text_options()).schema(schema).load(f"{path}/{FILES}").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), *zone_columns
    ).groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("rows"), *ranges).write.mode("overwrite").parquet(f"{path}/{ZONES}")


def _text_options() -> dict:
    return {
        "sep": SEPARATOR, "header": True, "quote": '"', "escape": '"', "timestampFormat": TIME, "nullValue": "",
        "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "multiLine": True,
    }


def load_snapshots(spark: SparkSession, path: str, condition: Column | str | None = None) -> DataFrame:
    """The events under ``path`` that meet ``condition``, through the source below.

    Comparisons joined by "and" are pushed into the source; the rest, and all
    later filters without a condition here, are Spark's. Spark plans what was
    pushed once for each frame, so use a frame with a condition once in a plan:
    to join two ranges, load each of them. The session must allow pushdown into
    Python sources, which a condition switches on.
    """
    ship_package(spark)
    spark.dataSource.register(EventSnapshots)
    reader = spark.read.format(FORMAT).option("path", path).option("pushdown", str(condition is not None))
    if condition is None:
        return reader.load()
    spark.conf.set(PUSHDOWN, "true")
    return reader.load().filter(condition)


class EventSnapshots(DataSource):
    """Options: ``path``, ``pushdown`` (True or False), and ``partitionBytes`` of text for one task (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return EVENT_SCHEMA

    def reader(self, schema: StructType) -> SnapshotReader:
        pushdown = self.options.get("pushdown", "False").lower() == "true"
        return SnapshotReader(schema, self.options["path"], int(self.options.get("partitionBytes", 64 << 20)), pushdown)


@dataclass
class Files(InputPartition):
    files: list[str]

    def __init__(self, files: list[str]):
        self.files = files


@dataclass
class SnapshotReader(DataSourceReader):
    """``pushed`` holds (operation, column, value) of the comparisons taken from Spark."""

    wanted: StructType
    path: str
    partition_bytes: int
    pushdown: bool
    pushed: list[tuple] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.pushdown:
                yield f
            # Columns inside structs, NaN (which Spark calls equal to itself) and other kinds of filter stay with Spark.
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1:
                self.pushed.append(("known", f.attribute[0], None))
            elif isinstance(f, In) and len(f.attribute) == 1 and all(_plain(v) for v in f.value):
                self.pushed.append(("in", f.attribute[0], tuple(f.value)))
            elif type(f) in COMPARED and len(f.attribute) == 1 and _plain(f.value):
                self.pushed.append((COMPARED[type(f)].__name__, f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """The files that can hold a match, in parts of about ``partition_bytes``."""
        import pyarrow.dataset as ds

        system, path = _located(self.path)
        zones = ds.dataset(f"{path}/{ZONES}", filesystem=system, format="parquet")
        first = next(n for n in zones.schema.names if n.startswith("min_"))
        found = zones.to_table(columns=["file", "bytes", first], filter=self._zone_filter(set(zones.schema.names))).sort_by(first)
        parts, size = [[]], 0
        for file, each in zip(found.column("file").to_pylist(), found.column("bytes").to_pylist(), strict=True):
            if parts[-1] and size + each > self.partition_bytes:
                parts.append([])
                size = 0
            parts[-1].append(file)
            size += each
        return [Files(p) for p in parts]

    def _zone_filter(self, known: set[str]):
        import pyarrow.compute as pc

        conditions = []
        for name, column, value in self.pushed:
            if f"min_{column}" not in known:
                continue
            low, high = pc.field(f"min_{column}"), pc.field(f"max_{column}")
            floating = isinstance(self.wanted[column].dataType, DoubleType)
            values = [self._value(column, v, whole=True) for v in (value if name == "in" else [value])]
            if name == "known":
                conditions.append(high.is_valid())
                continue
            # Spark's greatest double is NaN, so a file whose maximum it is may hold anything above the minimum.
            above = [(high >= v) | pc.is_nan(high) if floating else high >= v for v in values]
            below = [low <= v for v in values]
            if name in ("gt", "ge"):
                conditions.append(above[0])
            elif name in ("lt", "le"):
                conditions.append(below[0])
            else:
                conditions.append(functools.reduce(operator.or_, [a & b for a, b in zip(above, below, strict=True)], pc.scalar(False)))
        return functools.reduce(operator.and_, conditions) if conditions else None

    def _row_filter(self):
        import pyarrow.compute as pc

        conditions = []
        for name, column, value in self.pushed:
            at = pc.field(column)
            if name == "known":
                conditions.append(at.is_valid())
            elif name == "in":
                conditions.append(at.isin([self._value(column, v) for v in value]))
            else:
                test = getattr(operator, name)(at, self._value(column, value))
                if name in ("gt", "ge") and isinstance(self.wanted[column].dataType, DoubleType):
                    test = test | pc.is_nan(at)
                conditions.append(test)
        return functools.reduce(operator.and_, conditions) if conditions else None

    def _value(self, column: str, value, whole: bool = False):
        """A literal for lines, or for the zone map (``whole``: times as microseconds)."""
        import pyarrow as pa

        if value is None or not isinstance(self.wanted[column].dataType, TimestampType):
            return value
        micros = (value - datetime(1970, 1, 1, tzinfo=timezone.utc if value.tzinfo else None)) // timedelta(microseconds=1)
        return micros if whole else pa.scalar(micros, pa.timestamp("us", "UTC"))

    def read(self, partition: Files):
        import pyarrow as pa
        from pyarrow import csv
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:
            return
        schema = to_arrow_schema(self.wanted)
        keep = self._row_filter()
        for file in partition.files:
            system, path = _located(file)
            with system.open_input_stream(path, compression="detect") as stream:
                lines = csv.open_csv(
                    stream,
                    parse_options=csv.ParseOptions(delimiter=SEPARATOR, newlines_in_values=True),
                    convert_options=csv.ConvertOptions(
                        column_types=schema, include_columns=schema.names, null_values=[""],
                        strings_can_be_null=True, quoted_strings_can_be_null=False,
                    ),
                )
                for batch in lines:
                    rows = pa.Table.from_batches([batch])
                    yield from (rows.filter(keep) if keep is not None else rows).to_batches()


def _plain(value) -> bool:
    return value is not None and value == value


def _located(uri: str):
    """File system and path of a URI, or of a plain local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
