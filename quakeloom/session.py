"""Session helpers: a local factory and the reliable staging area."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quakeloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, as
    in tests, gets a temporary folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="quakeloom-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context.

    Functions of ``mapInArrow`` and its kin are pickled by reference, so a
    worker must be able to import their module wherever the driver started.
    """
    context = spark.sparkContext
    if getattr(context, "_quakeloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quakeloom-ship-")) / "quakeloom.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(package.rglob("*.py")):
            target.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._quakeloom_shipped = True


_runs: list[str] = []


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """Tables staged inside go to one folder, which is deleted at the end.

    For callers that write their result before they leave: a lazy result that
    is read later still needs its staged tables.
    """
    folder = f"{checkpoint_dir(spark)}/quakeloom/run-{uuid.uuid4().hex}"
    _runs.append(folder)
    try:
        yield folder
    finally:
        _runs.remove(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staging_path(spark: SparkSession) -> str:
    """A new path in the staging area."""
    parent = _runs[-1] if _runs else f"{checkpoint_dir(spark)}/quakeloom"
    return f"{parent}/{uuid.uuid4().hex}"


def staged(frame: DataFrame) -> DataFrame:
    """Materialise as a table in the shared checkpoint folder.

    Lineage is cut there, so a lost executor costs a re-read, not a recompute,
    and the planner sees the real size of the table when it picks a join.
    """
    spark = frame.sparkSession
    path = staging_path(spark)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def spread_evenly(frame: DataFrame, *keys: str) -> DataFrame:
    """Use every shuffle partition before a step that multiplies rows; the
    adaptive planner would fold a small table into one task."""
    count = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(count, *keys)


def in_stretches(frame: DataFrame, *keys: str) -> DataFrame:
    """As ``spread_evenly``, with neighbouring keys in one task."""
    count = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartitionByRange(count, *keys)


ROWS_PER_TASK = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Shuffle tasks for so many rows: as the session says, more where a task would get too many."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))


def with_row_key(frame: DataFrame, name: str = "_row") -> DataFrame:
    """Attach a row identity that stays the same however often it is read."""
    return staged(frame.withColumn(name, F.monotonically_increasing_id()))
