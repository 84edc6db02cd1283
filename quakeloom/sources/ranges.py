"""Half-open ranges of time that were asked for, are held, or failed.

A range is [start, end). Sets of ranges are tables, with one set for each value
of the key columns, and their algebra is a sweep over borders: every range opens
at its start and closes at its end, and a running count tells what covers the
stretch between two borders. Nothing is compared pair by pair, and ranges may
overlap, touch, repeat, or cut each other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.session import staged, tasks_for

START, END = "chunk_start", "chunk_end"
COMPLETE, PARTIAL, FAILED = "complete", "partial", "failed"


def _placed(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """Each different range once, with its ``_count``, all ranges of a key in one task.

    The number of tasks follows the number of ranges. Every later step groups or
    sorts within a key and needs no further shuffle. Repeated ranges are added up
    by many tasks before those of a key meet. Empty and reversed ranges, and
    ranges with an open end, are none.
    """
    tagged = staged(tagged.filter(F.col(START) < F.col(END)))
    count = tasks_for(tagged.sparkSession, tagged.count())
    salted = tagged.withColumn("_salt", F.spark_partition_id() % 16)
    folded = (
        salted.repartition(count, *keys, START, END, "_salt")
        .groupBy(*keys, START, END, "_side", "_salt").agg(F.count(F.lit(1)).alias("_count"))
    )
    placed = folded.repartition(count, *keys) if keys else folded.repartition(1)
    return placed.groupBy(*keys, START, END, "_side").agg(F.sum("_count").alias("_count"))


def _borders(placed: DataFrame) -> DataFrame:
    """Two rows a range: +_count at its start, -_count at its end."""
    border = F.explode(
        F.array(
            F.struct(F.col(START).alias("at"), F.col("_count").alias("step")),
            F.struct(F.col(END).alias("at"), (-F.col("_count")).alias("step")),
        )
    )
    return placed.select("*", border.alias("_b")).select("*", F.col("_b.at").alias("_at"), F.col("_b.step").alias("_step")).drop("_b")


def _stretches(tagged: DataFrame, keys: list[str], sides: Sequence[str]) -> DataFrame:
    """Stretches between neighbouring borders with, for each side, how many of its ranges cover them.

    ``tagged`` has ``_side``. Equal borders are added up before they are sorted.
    """
    borders = (
        _borders(_placed(tagged, keys))
        .groupBy(*keys, "_at")
        .agg(*[F.sum(F.when(F.col("_side") == s, F.col("_step")).otherwise(0)).alias(s) for s in sides])
    )
    order = Window.partitionBy(*keys).orderBy("_at")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return borders.select(
        *keys,
        F.col("_at").alias(START),
        F.lead("_at").over(order).alias(END),
        *[F.sum(s).over(running).alias(s) for s in sides],
    ).filter(F.col(END).isNotNull())


def _joined(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches that touch become one range."""
    order = Window.partitionBy(*keys).orderBy(START)
    fresh = F.coalesce(F.lag(END).over(order) < F.col(START), F.lit(True))
    numbered = stretches.withColumn("_fresh", fresh.cast("int")).withColumn(
        "_group", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(*keys, "_group").agg(F.min(START).alias(START), F.max(END).alias(END)).drop("_group")


def _combined(left: DataFrame, right: DataFrame, keys: Sequence[str], condition: str) -> DataFrame:
    keys = list(keys)
    wanted = [*keys, START, END]
    tagged = left.select(*wanted, F.lit("_l").alias("_side")).unionByName(right.select(*wanted, F.lit("_r").alias("_side")))
    return _joined(_stretches(tagged, keys, ("_l", "_r")).filter(condition), keys)


def union(left: DataFrame, right: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Moments in either set, as disjoint ranges that do not touch."""
    return _combined(left, right, keys, "_l > 0 or _r > 0")


def intersection(left: DataFrame, right: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _combined(left, right, keys, "_l > 0 and _r > 0")


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Moments of ``left`` that ``right`` lacks."""
    return _combined(left, right, keys, "_l > 0 and _r = 0")


def gaps(asked: DataFrame, manifest: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What of the asked ranges no complete entry of the manifest holds: all that a rerun has to read."""
    return difference(asked, manifest.filter(F.col("status") == COMPLETE), keys)


def manifest_entries(asked: DataFrame, read: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One entry for each asked range: complete, partial or failed, with the seconds that are held.

    ``read`` are the ranges that arrived. An asked range may have been cut into
    many; it is complete when they cover all of it, whichever way they overlap.
    Repeated asked ranges are one. A range with a null key matches nothing that arrived.
    """
    keys = list(keys)
    tagged = asked.select(*keys, START, END, F.lit("_l").alias("_side")).unionByName(read.select(*keys, START, END, F.lit("_r").alias("_side")))
    order = Window.partitionBy(*keys).orderBy("_at")
    covering = F.sum(F.when(F.col("_side") == "_r", F.col("_step")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # What is held from a border to the next one; of equal borders only the last has a length.
    known = reduce(and_, [F.col(k).isNotNull() for k in keys], F.lit(True))
    swept = _borders(_placed(tagged, keys)).withColumn(
        "_length", F.when((covering > 0) & known, F.unix_micros(F.lead("_at").over(order)) - F.unix_micros("_at"))
    )
    # Held time of a range is the running total at its end less that at its start, as both are borders.
    before = F.coalesce(F.sum("_length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = swept.select(*keys, START, END, "_side", F.when(F.col("_step") > 0, -before).otherwise(before).alias("_held"))
    held = totals.filter("_side = '_l'").groupBy(*keys, START, END).agg(F.sum("_held").alias("_micros"))
    micros, whole = F.col("_micros"), F.unix_micros(END) - F.unix_micros(START)
    status = F.when(micros == whole, COMPLETE).when(micros > 0, PARTIAL).otherwise(FAILED)
    return held.select(*keys, START, END, status.alias("status"), (micros / 1e6).alias("held_seconds"))
