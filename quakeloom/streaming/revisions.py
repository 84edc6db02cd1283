"""A stream of revisions: the latest one of every event wins, across batches.

The dataset is versioned (`sources.versions`). A batch reads and writes only the
partitions that hold one of its events, before or after; so a revision may move
an event to another partition. The batch's number is part of the version that
it makes, so a batch that is played again after a crash changes nothing. The
order in which revisions arrive does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quakeloom.schema import keep_last
from quakeloom.session import staged
from quakeloom.sources import versions

DELETED = "deleted"


def _latest(frame: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of revisions that tie in ``order``, the one with the greater hash stays."""
    others = [c for c in frame.columns if c not in keys]
    return keep_last(frame.withColumn("_tie", F.xxhash64(*others)), list(keys), [*order, "_tie"]).drop("_tie")


def merge(
    batch: DataFrame,
    root: str,
    keys: Sequence[str],
    order: Sequence[str],
    partition_by: Sequence[str],
    stream: tuple[str, int] | None = None,
) -> int | None:
    """Merge revisions into the dataset; the new version, or None if the batch is in it already.

    A row with ``deleted`` true takes the event away; it stays as a mark, so that
    an older revision which comes later does not bring the event back. A null in
    ``order`` is older than anything; rows with a null key are one event.
    """
    spark = batch.sparkSession
    present = versions.entry(spark, root)
    if present and stream and present["streams"].get(stream[0], -1) >= stream[1]:
        return None
    new = staged(_latest(batch, keys, order))
    if present is None:
        return versions.commit(new, root, partition_by, stream=stream)
    old = versions.read(spark, root)
    texts = [F.col(c).cast("string").alias(c) for c in partition_by]
    marks = new.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same: Column = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    moved = old.join(marks, same, "left_semi")
    # One row a partition: their number is what the log holds anyway.
    touched = [tuple(r) for r in new.select(*texts).union(moved.select(*texts)).distinct().collect()]
    if not touched:
        return versions.commit(new, root, partition_by, "partitions", stream=stream)
    hit: Column = F.lit(False)
    for values in touched:
        one: Column = F.lit(True)
        for name, value in zip(partition_by, values, strict=True):
            one = one & F.col(name).eqNullSafe(F.lit(value).cast(old.schema[name].dataType))
        hit = hit | one
    merged = _latest(old.filter(hit).unionByName(new), keys, order)
    return versions.commit(merged, root, partition_by, "partitions", touched, stream=stream)


def current(spark: SparkSession, root: str) -> DataFrame:
    """Events that were not taken away, each in its latest revision."""
    found = versions.read(spark, root)
    return found.filter(~F.coalesce(DELETED, F.lit(False))).drop(DELETED) if DELETED in found.columns else found


def start(
    revisions: DataFrame,
    root: str,
    checkpoint: str,
    keys: Sequence[str],
    order: Sequence[str],
    partition_by: Sequence[str],
    name: str = "revisions",
) -> StreamingQuery:
    """Merge what has arrived, batch by batch, then stop. ``name`` belongs to one checkpoint."""

    def apply(batch: DataFrame, number: int) -> None:
        merge(batch, root, keys, order, partition_by, (name, number))

    return (
        revisions.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
