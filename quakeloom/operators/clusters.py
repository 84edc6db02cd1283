"""Clusters of map points for every zoom level, from one pass over a quadtree.

Points are counted in cells of the finest level first; a cell's code interleaves
the bits of its column and row, so a coarser cell is a shift of the code. What
leaves that first aggregation is bounded by the cells of the map, however many
points it has, and all levels come from it in one more aggregation. Level n
splits longitudes and latitudes into 2^n parts each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeloom.functions.scalar import clip

FINEST = 12


def _part(value: Column, low: float, width: float, level: int) -> Column:
    """Column or row of a coordinate; what lies on the far border belongs to the last."""
    parts = 1 << level
    return F.least(F.greatest(F.floor((value - low) / F.lit(width) * parts), F.lit(0)), F.lit(parts - 1)).cast("long")


def cell_code(latitude: Column, longitude: Column, level: int) -> Column:
    """Bits of column and row, interleaved; the column has the even places."""
    x, y = _part(longitude, -180.0, 360.0, level), _part(latitude, -90.0, 180.0, level)
    code = F.lit(0).cast("long")
    for bit in range(level):
        one = F.lit(1 << bit).cast("long")
        code = code.bitwiseOR(F.shiftleft(x.bitwiseAND(one), bit)).bitwiseOR(F.shiftleft(y.bitwiseAND(one), bit + 1))
    return code


def _total(frame: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return frame.groupBy(*keys).agg(
        F.sum("events").alias("events"), F.sum("_lat").alias("_lat"), F.sum("_lon").alias("_lon"), F.min("_first").alias("_first"), *more
    )


def cluster_pyramid(points: DataFrame, finest: int = FINEST, coarsest: int = 0) -> DataFrame:
    """One row per level and cell that has points.

    Of points (event_id, latitude, longitude, magnitude_comparable): events,
    mean position, the strongest event (ties: smallest id; a null magnitude is
    the least), ``children`` (cells of the next level in it; null at the finest)
    and ``expand_level``, the first level at which the cluster falls apart (null
    if it does not). Points without a position are left out.
    """
    if not 0 <= coarsest <= finest <= 30:
        raise ValueError("0 <= coarsest <= finest <= 30")
    magnitude = F.col("magnitude_comparable")
    cells = _total(
        points.filter("latitude is not null and longitude is not null and not isnan(latitude) and not isnan(longitude)").select(
            cell_code(F.col("latitude"), F.col("longitude"), finest).alias("_code"),
            F.lit(1).cast("long").alias("events"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"),
            F.struct(magnitude.isNull().alias("none"), (-magnitude).alias("m"), F.col("event_id").alias("id")).alias("_first"),
        ),
        ["_code"],
    )
    above = F.lit(finest) - F.col("level")
    each = cells.withColumn("level", F.explode(F.sequence(F.lit(coarsest), F.lit(finest)))).withColumn(
        "cell", F.expr(f"shiftright(_code, 2 * ({finest} - level))")
    )
    # Which quarters of the cell hold points, a bit each.
    quarter = F.when(above > 0, F.expr(f"shiftleft(1, cast(shiftright(_code, 2 * ({finest} - level - 1)) & 3 as int))"))
    merged = _total(
        each, ["level", "cell"], F.bit_count(F.bit_or(quarter)).cast("int").alias("children"),
        F.min("_code").alias("_low"), F.max("_code").alias("_high"),
    )
    # The highest pair of bits in which two of its finest cells differ.
    apart = F.length(F.bin(F.col("_low").bitwiseXOR(F.col("_high")))) - 1
    return merged.select(
        "level", "cell", "events",
        (F.col("_lat") / F.col("events")).alias("latitude"), (F.col("_lon") / F.col("events")).alias("longitude"),
        (-F.col("_first.m")).alias("maximum_magnitude"), F.col("_first.id").alias("strongest_event"), "children",
        F.when(F.col("_low") != F.col("_high"), F.lit(finest) - F.floor(apart / 2)).cast("int").alias("expand_level"),
        clip(F.sqrt("events") * 2.8 + 7.0, 8.0, 34.0).alias("marker_size"),
    )


def clusters_in_view(pyramid: DataFrame, level: int, south: float, west: float, north: float, east: float) -> DataFrame:
    """Clusters of a level whose mean position lies in a box; ``west`` > ``east`` crosses the date line."""
    longitude = F.col("longitude")
    across = longitude.between(west, east) if west <= east else (longitude >= west) | (longitude <= east)
    return pyramid.filter((F.col("level") == level) & F.col("latitude").between(south, north) & across)
