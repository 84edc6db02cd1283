"""Region assignment: polygon cover, overlap and near-miss rules as one narrow
projection. Polygons are configuration literals, so nothing is joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeloom.fixed_values import (
    NEAR_REGION_DEGREES,
    OUTSIDE_REGION,
    REGION_CONFIDENCE,
    REGIONS,
    UNCLASSIFIED_REGION,
)
from quakeloom.schema import conform

Ring = Sequence[tuple[float, float]]
Region = tuple[str, Ring]


def ring_edges(ring: Ring) -> list[tuple[float, float, float, float]]:
    points = list(ring)
    if points[0] == points[-1]:
        points = points[:-1]
    return [(*a, *b) for a, b in zip(points, points[1:] + points[:1])]


def planar_area(ring: Ring) -> float:
    return abs(sum(x1 * y2 - x2 * y1 for x1, y1, x2, y2 in ring_edges(ring))) / 2


def _on_edge(x: Column, y: Column, edge: tuple[float, float, float, float]) -> Column:
    x1, y1, x2, y2 = edge
    cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
    return (
        (cross == 0)
        & x.between(min(x1, x2), max(x1, x2))
        & y.between(min(y1, y2), max(y1, y2))
    )


def covers(ring: Ring, x: Column, y: Column) -> Column:
    """Point in or on the ring (even-odd rule plus an explicit border test)."""
    border, crossings = F.lit(False), F.lit(0)
    for edge in ring_edges(ring):
        x1, y1, x2, y2 = edge
        border = border | _on_edge(x, y, edge)
        if y1 == y2:
            continue
        straddles = (F.lit(y1) > y) != (F.lit(y2) > y)
        right = x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        crossings = crossings + F.when(straddles & right, 1).otherwise(0)
    return border | (crossings % 2 == 1)


def ring_distance(ring: Ring, x: Column, y: Column) -> Column:
    """Planar distance in degrees from an outside point to the ring."""
    distances = []
    for x1, y1, x2, y2 in ring_edges(ring):
        dx, dy = x2 - x1, y2 - y1
        length2 = dx * dx + dy * dy
        t = ((x - x1) * dx + (y - y1) * dy) / length2
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        distances.append(F.hypot(x - (t * dx + x1), y - (t * dy + y1)))
    return F.least(*distances)


def with_region(
    frame: DataFrame, regions: Sequence[Region] = REGIONS, lat: str = "latitude", lon: str = "longitude"
) -> DataFrame:
    """Add ``_region`` struct(name, confidence) for each point.

    Cover tests and distances are columns of their own first, so that the rule
    chain refers to them and does not repeat them.
    """
    y, x = F.col(lat), F.col(lon)
    count = len(regions)
    tested = frame.select(
        "*",
        *[covers(ring, x, y).alias(f"_in{i}") for i, (_, ring) in enumerate(regions)],
        *[ring_distance(ring, x, y).alias(f"_d{i}") for i, (_, ring) in enumerate(regions)],
    )
    hits = sum((F.col(f"_in{i}").cast("int") for i in range(count)), F.lit(0))
    nearest = F.array_min(F.array(*[F.col(f"_d{i}") for i in range(count)]))

    def answer(name: str, kind: str) -> Column:
        return F.struct(
            F.lit(name).alias("name"), F.lit(REGION_CONFIDENCE[kind]).alias("confidence")
        )

    chain = F.when(y.isNull() | x.isNull(), answer(UNCLASSIFIED_REGION, "missing"))
    # sorted() is stable, so equal areas keep the configured order
    for i in sorted(range(count), key=lambda k: planar_area(regions[k][1])):
        inside = F.col(f"_in{i}")
        chain = chain.when(inside & (F.col("_hits") == 1), answer(regions[i][0], "single"))
        chain = chain.when(inside, answer(regions[i][0], "overlap"))
    for i, (name, _) in enumerate(regions):
        near = (F.col(f"_d{i}") == F.col("_near")) & (F.col("_near") <= NEAR_REGION_DEGREES)
        chain = chain.when(near, answer(name, "near"))
    return tested.select("*", hits.alias("_hits"), nearest.alias("_near")).select(
        *frame.columns, chain.otherwise(answer(OUTSIDE_REGION, "outside")).alias("_region")
    )


def classify_events(frame: DataFrame, regions: Sequence[Region] = REGIONS) -> DataFrame:
    return conform(
        with_region(conform(frame), regions).withColumns(
            {
                "tectonic_domain": F.col("_region.name"),
                "domain_confidence": F.col("_region.confidence"),
            }
        )
    )
