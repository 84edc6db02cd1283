"""Harmonised event schema: conformance, plausibility, stable identifiers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.fixed_values import EVENT_FIELDS, EVENT_ID_PREFIX, PLAUSIBLE_RANGE

EVENT_COLUMNS = [name for name, _ in EVENT_FIELDS]
EVENT_SCHEMA = ", ".join(f"{n} {t}" for n, t in EVENT_FIELDS)


def _mark(name: str) -> dict[str, str]:
    """Column metadata that says a value already went through `conform` under
    this name, so that a chain of operators does not nest the same checks again
    and again. Metadata survives a rename; the name in it does not match then."""
    return {"conformed": name}


def plausible(column: Column, name: str) -> Column:
    """NULL outside the inclusive bounds; NaN and infinities are outside too."""
    low, high = PLAUSIBLE_RANGE[name]
    return F.when(column.between(low, high), column)


def conform(frame: DataFrame, id_column: str = "event_id") -> DataFrame:
    """Project to the harmonised schema; bad values become NULL, never errors.

    A narrow projection: no shuffle, and unused output columns prune back to
    the scan.
    """
    if id_column != "event_id" and id_column in frame.columns:
        frame = frame.withColumnRenamed(id_column, "event_id")
    given = {f.name: f for f in frame.schema.fields}
    done = {
        name for name, kind in EVENT_FIELDS
        if name in given and given[name].metadata.get("conformed") == name
        and given[name].dataType.simpleString() == kind
    }
    out: dict[str, Column] = {}
    for name, kind in EVENT_FIELDS:
        if name not in given:
            out[name] = F.lit(None).cast(kind)
            continue
        value = F.col(name)
        if name not in done:
            if given[name].dataType.simpleString() != kind:
                value = value.try_cast(kind)
            if name in PLAUSIBLE_RANGE:
                value = plausible(value, name)
        out[name] = value
    defaults = {
        "is_preferred_record": F.lit(True),
        "is_background_event": F.lit(False),
        "magnitude_original_value": out["magnitude_value"],
        "magnitude_original_type": out["magnitude_type"],
    }
    for name, default in defaults.items():
        if name not in done:
            out[name] = F.coalesce(out[name], default)
    return frame.select(
        [out[c] if c in done else out[c].alias(c, metadata=_mark(c)) for c in EVENT_COLUMNS]
    )


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT_SCHEMA)


def union_events(frames: Iterable[DataFrame | None], spark: SparkSession | None = None) -> DataFrame:
    """UNION ALL after conformance; missing columns are filled with NULL."""
    present = [conform(frame) for frame in frames if frame is not None]
    if not present:
        return empty_events(spark or SparkSession.active())
    return reduce(DataFrame.unionByName, present)


def timestamp_text(column: Column) -> Column:
    """``2024-01-31 05:06:07+00:00``, with microseconds only when non-zero."""
    whole = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    micros = F.pmod(F.unix_micros(column), F.lit(1_000_000))
    fraction = F.when(
        micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    ).otherwise("")
    return F.concat(whole, fraction, F.lit("+00:00"))


def stable_event_id(
    source: Column, source_event_id: Column, origin: Column, latitude: Column, longitude: Column
) -> Column:
    """Identifier from source, source id, time and place; zero and NULL are ''."""

    def number(column: Column) -> Column:
        return F.when(column != 0, column.cast("string")).otherwise("")

    raw = F.concat_ws(
        "|",
        F.coalesce(source, F.lit("")),
        F.coalesce(source_event_id, F.lit("")),
        F.coalesce(timestamp_text(origin), F.lit("")),
        F.coalesce(number(latitude), F.lit("")),
        F.coalesce(number(longitude), F.lit("")),
    )
    return F.concat(F.lit(EVENT_ID_PREFIX), F.upper(F.substring(F.sha1(raw), 1, 16)))


def keep_last(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """DISTINCT on ``keys`` keeping the last row in ``order``.

    ``max_by`` over the whole row combines on the map side, so one key with a
    third of the rows costs one partial row per task.
    """
    others = [c for c in frame.columns if c not in keys]
    packed = frame.groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    )
    return packed.select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in frame.columns]
    )
