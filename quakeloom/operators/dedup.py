"""Fuzzy duplicate grouping: a space-time-magnitude band self-join followed by
connected components, without ever listing the pairs of a dense group.

Records are placed in cells so small that any two records of one cell are
duplicates of each other. Cells, not records, are the nodes of the graph; a
cell has a bounded number of possible neighbour cells. Bounding boxes settle
most neighbour pairs; only pairs that straddle a limit look at records, after
splitting cells until the work per pair is bounded. What the boxes and one pair
of witnesses join is merged first, so that only pairs of cells that may still
join two groups are looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeloom.fixed_values import EARTH_RADIUS_KM, SOURCE_PRIORITY, STATUS_PRIORITY
from quakeloom.functions.scalar import haversine_km
from quakeloom.operators.distributed import merged_components, relabelled
from quakeloom.schema import EVENT_COLUMNS, conform
from quakeloom.session import staged, tasks_for, with_row_key

KM_PER_DEGREE = math.radians(1) * EARTH_RADIUS_KM
BOX = ["n", *[f"{c}_{p}" for c in ("t", "lat", "lon", "mag") for p in ("lo", "hi")]]
PAIR_BUDGET = 4096  # record pairs tested per cell pair before cells are split


class Grid:
    """Cells whose members are mutual duplicates under the three limits."""

    def __init__(self, time_seconds: float, distance_km: float, magnitude_delta: float):
        self.time_us = max(int(time_seconds * 1_000_000), 1)
        self.distance_km = float(distance_km)
        self.magnitude_delta = float(magnitude_delta)
        self.limit_us = int(time_seconds * 1_000_000)
        side = max(distance_km, 1e-6) / math.sqrt(2) * 0.98
        self.side_km = min(side, KM_PER_DEGREE * 10)
        self.bands = math.ceil(180.0 / (self.side_km / KM_PER_DEGREE))
        self.lat_step = 180.0 / self.bands
        self.mag_step = magnitude_delta * 0.999 if magnitude_delta > 0 else 1e-9

    def band(self, lat: Column) -> Column:
        index = F.floor((lat + 90.0) / self.lat_step)
        return F.least(F.greatest(index, F.lit(0)), F.lit(self.bands - 1))

    def lon_cells(self, band: Column) -> Column:
        """Number of equal longitude cells in a band (its widest parallel)."""
        low = band * self.lat_step - 90.0
        high = low + self.lat_step
        nearest = F.when((low <= 0) & (high >= 0), F.lit(0.0)).otherwise(
            F.least(F.abs(low), F.abs(high))
        )
        circle = F.cos(F.radians(nearest)) * (360.0 * KM_PER_DEGREE)
        return F.greatest(F.ceil(circle / self.side_km), F.lit(1))

    def lon_cell(self, lon: Column, cells: Column) -> Column:
        return F.pmod(F.floor((lon + 180.0) / (F.lit(360.0) / cells)), cells)

    def keyed(self, points: DataFrame) -> DataFrame:
        with_cell = points.withColumn("tb", F.floor(F.col("t") / F.lit(self.time_us)).cast("long"))
        with_cell = with_cell.withColumn("band", self.band(F.col("lat")))
        with_cell = with_cell.withColumn(
            "lonc", self.lon_cell(F.col("lon"), self.lon_cells(F.col("band")))
        ).withColumn("mb", F.floor(F.col("mag") / F.lit(self.mag_step)).cast("long"))
        return with_cell.withColumn(
            "cell",
            F.concat_ws(
                ":", "tb", "band", "lonc", F.coalesce(F.col("mb").cast("string"), F.lit("none"))
            ),
        )

    def box_sums(self) -> list[Column]:
        return [
            F.count(F.lit(1)).alias("n"),
            *[f(c).alias(f"{c}_{p}") for c in ("t", "lat", "lon", "mag")
              for p, f in (("lo", F.min), ("hi", F.max))],
        ]

    def boxes(self, points: DataFrame, keys: list[str]) -> DataFrame:
        return points.groupBy(*keys).agg(*self.box_sums())

    def neighbour_keys(self, boxes: DataFrame) -> DataFrame:
        """One row per (cell, neighbouring time bucket, band, longitude cell).

        Of two cells of one time bucket, the one in the lower band looks for the other.
        """
        reach = math.degrees(self.distance_km / EARTH_RADIUS_KM) * (1 + 1e-9)
        first = self.band(F.col("lat_lo") - reach)
        last = self.band(F.col("lat_hi") + reach)
        spread = boxes.withColumn("n_band", F.explode(F.sequence(first, last)))
        spread = spread.withColumn("_cells", self.lon_cells(F.col("n_band")))
        low = F.col("n_band") * self.lat_step - 90.0
        farthest = F.greatest(
            F.abs(low), F.abs(low + self.lat_step), F.abs("lat_lo"), F.abs("lat_hi")
        )
        cosine = F.cos(F.radians(F.least(farthest, F.lit(90.0))))
        ratio = F.lit(math.sin(min(self.distance_km / (2 * EARTH_RADIUS_KM), math.pi / 2))) / cosine
        delta = F.when((cosine <= 1e-9) | (ratio >= 1), F.lit(180.0)).otherwise(
            F.degrees(F.asin(ratio)) * (2 * (1 + 1e-9))
        )
        width = F.lit(360.0) / F.col("_cells")
        start = F.floor((F.col("lon_lo") - delta + 180.0) / width)
        end = F.floor((F.col("lon_hi") + delta + 180.0) / width)
        end = F.least(end, start + F.col("_cells") - 1)
        return (
            spread.withColumn("_lonc", F.explode(F.sequence(start, end)))
            .withColumn("n_lonc", F.pmod("_lonc", "_cells"))
            .withColumn("n_tb", F.explode(F.array(F.col("tb"), F.col("tb") + 1)))
            .filter("n_tb > tb or n_band >= band")
            .drop("_lonc", "_cells")
        )

    def verdict(self) -> Column:
        """'yes' / 'no' / 'open' for boxes a.* and b.*."""
        a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))

        def widest(c: str) -> Column:
            return F.greatest(a(f"{c}_hi"), b(f"{c}_hi")) - F.least(a(f"{c}_lo"), b(f"{c}_lo"))

        def gap(c: str) -> Column:
            return F.greatest(
                F.greatest(a(f"{c}_lo"), b(f"{c}_lo")) - F.least(a(f"{c}_hi"), b(f"{c}_hi")),
                F.lit(0),
            )

        def cosines(side, pick) -> Column:
            low, high = F.cos(F.radians(side("lat_lo"))), F.cos(F.radians(side("lat_hi")))
            if pick == "min":
                return F.least(low, high)
            return F.when((side("lat_lo") <= 0) & (side("lat_hi") >= 0), F.lit(1.0)).otherwise(
                F.greatest(low, high)
            )

        # longitude intervals on the circle
        shift = a("lon_lo") - b("lon_lo")
        turn = F.when(shift > 180, 360.0).when(shift < -180, -360.0).otherwise(0.0)
        b_lo, b_hi = b("lon_lo") + turn, b("lon_hi") + turn
        lon_wide = F.least(
            F.greatest(a("lon_hi"), b_hi) - F.least(a("lon_lo"), b_lo), F.lit(180.0)
        )
        lon_gap = F.greatest(
            F.greatest(a("lon_lo"), b_lo) - F.least(a("lon_hi"), b_hi), F.lit(0.0)
        )
        # a gap wider than half a turn is shorter the other way round
        lon_gap = F.when(lon_gap > 180, F.lit(0.0)).otherwise(lon_gap)

        def arc(dlat: Column, dlon: Column, cos2: Column) -> Column:
            s1, s2 = F.sin(F.radians(dlat) / 2), F.sin(F.radians(dlon) / 2)
            return F.asin(F.sqrt(F.least(s1 * s1 + cos2 * s2 * s2, F.lit(1.0)))) * (
                2 * EARTH_RADIUS_KM
            )

        upper = arc(widest("lat"), lon_wide, cosines(a, "max") * cosines(b, "max"))
        lower = arc(gap("lat"), lon_gap, cosines(a, "min") * cosines(b, "min"))
        no_magnitude = a("mag_lo").isNull() | b("mag_lo").isNull()
        slack = 1e-6
        yes = (
            (widest("t") <= self.limit_us)
            & (upper <= self.distance_km - slack)
            & (no_magnitude | (widest("mag") <= self.magnitude_delta - 1e-9))
        )
        no = (
            (gap("t") > self.limit_us)
            | (lower > self.distance_km + slack)
            | (~no_magnitude & (gap("mag") > self.magnitude_delta + 1e-9))
        )
        return F.when(yes, "yes").when(no, "no").otherwise("open")

    def same_event(self, one: str = "p", other: str = "q") -> Column:
        """The exact pair test on points p.* and q.*; all limits inclusive."""
        p, q = (lambda c: F.col(f"{one}.{c}")), (lambda c: F.col(f"{other}.{c}"))
        return (
            (F.abs(p("t") - q("t")) <= self.limit_us)
            & (haversine_km(p("lat"), p("lon"), q("lat"), q("lon")) <= self.distance_km)
            & (
                p("mag").isNull()
                | q("mag").isNull()
                | (F.abs(p("mag") - q("mag")) <= self.magnitude_delta)
            )
        )

    def sub_key(self, level: int) -> Column:
        parts = 2**level
        width = F.lit(360.0) / self.lon_cells(F.col("band"))
        return F.concat_ws(
            ":",
            F.floor(F.col("t") * F.lit(float(parts)) / F.lit(self.time_us)),
            F.floor((F.col("lat") + 90.0) * (parts / self.lat_step)),
            F.floor((F.col("lon") + 180.0) * F.lit(float(parts)) / width),
            F.coalesce(F.floor(F.col("mag") * (parts / self.mag_step)).cast("string"), F.lit("none")),
        )


def _points(events: DataFrame) -> DataFrame:
    return events.select(
        F.unix_micros("origin_time_utc").alias("t"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        F.col("magnitude_value").alias("mag"),
    )


def _cells(points: DataFrame, grid: Grid) -> DataFrame:
    """Boxes of the cells, with a number each and their first and last point as witnesses."""
    witness = F.struct("t", "lat", "lon", "mag")
    keys = ["cell", "tb", "band", "lonc"]
    boxes = points.groupBy(*keys).agg(
        *grid.box_sums(), F.min(witness).alias("first"), F.max(witness).alias("last")
    )
    return staged(boxes.withColumn("node", F.monotonically_increasing_id()))


def _near_pairs(cells: DataFrame, grid: Grid) -> DataFrame:
    """Pairs (a, b) of cells that hold a duplicate pair ('yes') or may hold one ('open')."""
    # Cells are hashed, not sorted, as each is looked up under many keys; a task holds few of them.
    count = tasks_for(cells.sparkSession, 4 * cells.count())
    place = ["n_tb", "n_band", "n_lonc"]
    sides = [
        f.select(*kept).repartition(count, *place)
        for f, kept in (
            (grid.neighbour_keys(cells), [*place, "tb", "band", "node", *BOX, "last"]),
            (
                cells.withColumnsRenamed({"tb": "n_tb", "band": "n_band", "lonc": "n_lonc"}),
                [*place, "node", *BOX, "first"],
            ),
        )
    ]
    a, b = sides[0].alias("a"), sides[1].alias("b")
    met = a.join(
        b.hint("shuffle_hash"),
        (F.col("a.n_tb") == F.col("b.n_tb"))
        & (F.col("a.n_band") == F.col("b.n_band"))
        & (F.col("a.n_lonc") == F.col("b.n_lonc")),
    ).filter(
        (F.col("a.tb") < F.col("a.n_tb")) | (F.col("a.band") < F.col("a.n_band")) | (F.col("a.node") < F.col("b.node"))
    )
    verdict = F.when(
        (F.col("_v") == "open") & grid.same_event("a.last", "b.first"), "yes"
    ).otherwise(F.col("_v"))
    return staged(
        met.withColumn("_v", grid.verdict())
        .filter("_v <> 'no'")
        .select(
            F.col("a.node").alias("a"), F.col("b.node").alias("b"), verdict.alias("verdict"),
            (F.col("a.n").cast("double") * F.col("b.n")).alias("work"),
        )
    )


def duplicate_components(points: DataFrame, grid: Grid) -> DataFrame:
    """(cell, component) of cells that a chain of duplicate pairs connects.

    ``points``: distinct (t, lat, lon, mag) rows with their cell columns.
    """
    cells = _cells(points, grid)
    pairs = _near_pairs(cells, grid)
    sure = staged(merged_components(pairs.filter("verdict = 'yes'")))
    named = relabelled(
        pairs.filter("verdict = 'open'").select("a", "b", "work", F.col("a").alias("na"), F.col("b").alias("nb")), sure
    )
    undecided = staged(named.select(F.col("na").alias("a"), F.col("nb").alias("b"), "work"))
    found = sure
    if not undecided.isEmpty():
        asked = undecided.select(F.col("a").alias("node")).union(undecided.select("b")).distinct()
        numbered = points.join(cells.select("cell", "node").join(asked, "node"), "cell").drop("cell")
        edges = duplicate_edges(undecided, staged(numbered.withColumnRenamed("node", "cell")), grid)
        later = merged_components(relabelled(edges, sure)).withColumnsRenamed({"node": "_node", "component": "_later"})
        found = sure.join(later, F.col("component") == F.col("_node"), "full").select(
            F.coalesce("node", "_node").alias("node"), F.coalesce("_later", "component").alias("component")
        )
    return cells.select("cell", "node").join(found, "node").select("cell", "component")


def duplicate_edges(pairs: DataFrame, points: DataFrame, grid: Grid) -> DataFrame:
    """Those of the pairs (a, b, work) of cells that hold at least one duplicate pair."""
    edges = pairs.select("a", "b").limit(0)
    open_pairs = pairs.select("a", "b", F.lit("").alias("sa"), F.lit("").alias("sb"), "work")
    level = 0
    while True:
        light = open_pairs.filter(F.col("work") <= PAIR_BUDGET)
        heavy = open_pairs.filter(F.col("work") > PAIR_BUDGET)
        parent = F.lit("") if level == 0 else grid.sub_key(level)
        at_level = points.withColumn("sub", parent)
        tested = (
            light.alias("x")
            .join(at_level.alias("p"), (F.col("x.a") == F.col("p.cell")) & (F.col("x.sa") == F.col("p.sub")))
            .join(
                at_level.alias("q"),
                (F.col("x.b") == F.col("q.cell")) & (F.col("x.sb") == F.col("q.sub"))
                & grid.same_event(),
            )
            .select("x.a", "x.b").distinct()
        )
        edges = edges.union(tested)
        if heavy.isEmpty():
            return edges.distinct()
        # Split both cells of a heavy pair in half along every axis.
        level += 1
        children = grid.boxes(
            at_level.withColumn("child", grid.sub_key(level)), ["cell", "sub", "child"]
        )
        left = heavy.alias("x").join(
            children.alias("a"), (F.col("x.a") == F.col("a.cell")) & (F.col("x.sa") == F.col("a.sub"))
        )
        judged = staged(
            left.join(
                children.alias("b"),
                (F.col("x.b") == F.col("b.cell")) & (F.col("x.sb") == F.col("b.sub")),
            )
            .withColumn("verdict", grid.verdict())
            .filter("verdict <> 'no'")
            .select(
                "x.a", "x.b", F.col("a.child").alias("sa"), F.col("b.child").alias("sb"), "verdict",
                (F.col("a.n").cast("double") * F.col("b.n")).alias("work"),
            )
        )
        settled = judged.filter("verdict = 'yes'").select("a", "b").distinct()
        edges = edges.union(settled)
        open_pairs = staged(
            judged.filter("verdict = 'open'").drop("verdict").join(settled, ["a", "b"], "left_anti")
        )


def preference_order() -> list[Column]:
    """Ascending sort terms: the first record of a group is the preferred one."""
    source, status = F.lit(0), F.lit(0)
    for name, rank in SOURCE_PRIORITY.items():
        source = F.when(F.col("source") == name, rank).otherwise(source)
    for name, rank in STATUS_PRIORITY.items():
        status = F.when(F.col("record_status") == name, rank).otherwise(status)
    filled = sum(
        (F.col(c).isNotNull().cast("int")
         for c in ("depth_km", "magnitude_value", "magnitude_type", "location_text")),
        F.lit(0),
    )
    return [
        (-source).alias("p1"),
        (-status).alias("p2"),
        (-filled).alias("p3"),
        (-F.coalesce("quality_score", F.lit(0.0))).alias("p4"),
        F.col("origin_time_utc").alias("p5"),
        F.col("event_id").alias("p6"),
    ]


def _id_part(i: int) -> Column:
    """60 bits of an id's MD5; sums of them do not depend on the members' order."""
    digits = F.substring(F.md5(F.col("event_id").cast("binary")), 1 + 15 * i, 15)
    return F.conv(digits, 16, 10).cast("decimal(38,0)")


def group_records(
    frame: DataFrame, time_seconds: float = 90, distance_km: float = 35, magnitude_delta: float = 0.6
) -> DataFrame:
    """Located records with ``_row`` and the ``component`` of their cell."""
    grid = Grid(time_seconds, distance_km, magnitude_delta)
    events = with_row_key(
        conform(frame).filter(
            "origin_time_utc is not null and latitude is not null and longitude is not null"
        )
    )
    points = staged(grid.keyed(_points(events).distinct()))
    components = duplicate_components(points, grid).withColumnRenamed("cell", "node")
    keyed = grid.keyed(
        events.withColumns(
            {
                "t": F.unix_micros("origin_time_utc"),
                "lat": F.col("latitude"),
                "lon": F.col("longitude"),
                "mag": F.col("magnitude_value"),
            }
        )
    )
    joined = keyed.join(components, keyed["cell"] == components["node"], "left")
    return joined.select(
        *EVENT_COLUMNS, "_row", F.coalesce(F.col("component").cast("string"), F.concat(F.lit("cell "), "cell")).alias("component")
    )


def deduplicate_events(
    frame: DataFrame, time_seconds: float = 90, distance_km: float = 35, magnitude_delta: float = 0.6
) -> DataFrame:
    """Duplicate groups (transitive) and one preferred record per group."""
    records = staged(group_records(frame, time_seconds, distance_km, magnitude_delta))
    groups = (
        records.groupBy("component")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(F.struct(*preference_order(), F.col("_row"))).alias("_best"),
            F.min("event_id").alias("_first"),
            F.max("event_id").alias("_last"),
            *[F.sum(_id_part(i)).alias(f"_sum{i}") for i in (0, 1)],
        )
        .filter("_n > 1")
    )
    named = groups.select(
        "component",
        F.col("_best._row").alias("_best"),
        F.concat(
            F.lit("DUP-"),
            F.upper(F.substring(F.sha1(F.concat_ws("|", "_n", "_first", "_last", "_sum0", "_sum1")), 1, 12)),
        ).alias("_id"),
    )
    marked = records.join(named, "component", "left").withColumns(
        {
            "duplicate_group_id": F.col("_id"),
            "is_preferred_record": F.col("_best").isNull() | (F.col("_row") == F.col("_best")),
        }
    )
    return conform(marked)
