"""Region assignment against a layer of any number of polygons, by a grid.

The layer is a table. The plane is cut into square cells, smaller ones for a
crowded layer; a cell carries the number and the smallest of the regions that
cover it whole, and, for each region whose border passes through it and can still
matter, the edges of that region in the cell's row, which is all that the even-odd
rule looks at for a point in the cell. So a point meets the cell it lies in, one
equality join, and all tests are expressions on that row: no edge becomes part
of the plan, a hot cell is no group, and points are not moved when the index is
small enough for the planner to broadcast.

Regions are cut into cells in parts, the smallest first. Once two regions cover a
cell whole, no larger one changes what its points get, so most of a crowded layer
is found to be settled by its extent alone.

Even-odd counting over all rings makes holes and multipolygons right, and a point
on any ring is covered, as with the rule for single rings.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quakeloom.fixed_values import NEAR_REGION_DEGREES, OUTSIDE_REGION, REGION_CONFIDENCE, UNCLASSIFIED_REGION
from quakeloom.schema import conform
from quakeloom.session import spread_evenly, staged

CELL = 0.5
#: Cells are halved until so many edges cross one on average, but not more often than this.
BORDERS, HALVINGS = 16, 6
#: Cells taken by the first part of a layer, at least and at most, and how they grow from part to part.
FIRST, GROWTH = (4e6, 32e6), 4
#: Parts begin and end at one of about so many places.
BLOCKS = 4096
#: The first of two regions.
ORDER = ["area", "rank", "name"]
#: Ends of clipped edges are taken this much further, in cells, against rounding.
SLACK = 1e-6


def layer(polygons: DataFrame) -> DataFrame:
    """``polygons`` (name, rings, rank: the order among equals) with area and edges."""
    # Rings that repeat their first position and rings that do not are alike; edges without length say nothing.
    turned = "concat(slice(r, 2, size(r)), slice(r, 1, 1))"
    edges = F.expr(f"""
        filter(flatten(transform(rings, r -> zip_with(r, {turned}, (p, q) ->
            named_struct('x1', p[0], 'y1', p[1], 'x2', q[0], 'y2', q[1])))),
            e -> e.x1 != e.x2 or e.y1 != e.y2)
    """)
    # Holes turn the other way round only in tidy files, so the largest ring is taken for the size.
    area = F.expr(f"""
        array_max(transform(rings, r -> abs(aggregate(zip_with(r, {turned}, (p, q) -> p[0] * q[1] - q[0] * p[1]),
            cast(0 as double), (s, v) -> s + v)) / 2))
    """)
    # What explode returns is not made again where it is used, here and in the filters.
    rings = F.explode(F.array(F.filter("rings", lambda r: F.size(r) > 2))).alias("rings")
    usable = polygons.select("name", "rank", rings).filter(F.size("rings") > 0)
    made = usable.select("name", "rank", "rings", F.explode(F.array(edges)).alias("edges"))
    return made.filter(F.size("edges") > 0).select("name", "rank", area.alias("area"), "edges")


def covers(edges: Column, beyond: Column, x: Column, y: Column) -> Column:
    """Is the point on an edge, or has an odd number of edges to its right, ``beyond`` further ones among them?"""

    def on(e: Column) -> Column:
        cross = (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
        return (
            (cross == 0)
            & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    def right(e: Column) -> Column:
        straddles = (e["y1"] > y) != (e["y2"] > y)
        return straddles & (x < F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"])

    return F.exists(edges, on) | ((F.size(F.filter(edges, right)) + beyond) % 2 == 1)


def distance(edges: Column, x: Column, y: Column) -> Column:
    """Planar distance in degrees to the nearest edge."""

    def to(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        t = ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / (dx * dx + dy * dy)
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.hypot(x - (t * dx + e["x1"]), y - (t * dy + e["y1"]))

    return F.array_min(F.transform(edges, to))


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def _in_rows(edges: DataFrame, size: float, margin: float) -> DataFrame:
    """A row for each row of cells (``cy``) that an edge passes through, or comes as near as ``margin``
    to, with the first and the last cell there (``a``, ``b``). Edges with ``only`` some rows have just those."""
    e = F.col("e")
    low, high = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    first, last = _cell(low - margin, size), _cell(high + margin, size)
    found = F.filter("only", lambda r: r.between(first, last)) if "only" in edges.columns else F.sequence(first, last)
    rows = edges.select("*", F.explode(found).alias("cy")).drop("only")
    bottom = F.greatest(low, F.col("cy") * size - margin)
    top = F.least(high, (F.col("cy") + 1) * size + margin)
    flat = e["y1"] == e["y2"]
    a = F.when(flat, F.least(e["x1"], e["x2"])).otherwise(F.least(_at(bottom), _at(top))) - margin - size * SLACK
    b = F.when(flat, F.greatest(e["x1"], e["x2"])).otherwise(F.greatest(_at(bottom), _at(top))) + margin + size * SLACK
    return rows.select("*", _cell(a, size).alias("a"), _cell(b, size).alias("b"))


def _at(y: Column) -> Column:
    """Where the edge ``e`` has this height."""
    e = F.col("e")
    return F.coalesce(e["x1"] + F.try_divide((y - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"]), e["x1"])


@dataclass
class GridIndex:
    """``covering``: for each cell of ``fine`` degrees the number of regions that cover it whole
    (``inside``, two or more are alike), the first of them (``best``) and the ``border`` candidates;
    ``regions``: all of them, numbered. An index made for points that are ``asked`` has their cells
    only; those that no region covers whole are the ``bare`` ones."""

    covering: DataFrame
    regions: DataFrame
    fine: float
    near: float
    bare: DataFrame | None = None


def _numbered(regions: DataFrame) -> DataFrame:
    """Regions in the order of area, rank and name, with an ``id`` in that order, their extent and
    the ``length`` of their edges. Those alike in all three are one region."""
    alike = regions.groupBy(*ORDER).agg(F.flatten(F.collect_list("edges")).alias("edges"))
    least, most = (lambda a: lambda e: F.least(e[f"{a}1"], e[f"{a}2"])), (lambda a: lambda e: F.greatest(e[f"{a}1"], e[f"{a}2"]))
    extent = [F.array_min(F.transform("edges", least(a))).alias(f"lo_{a}") for a in "xy"]
    extent += [F.array_max(F.transform("edges", most(a))).alias(f"hi_{a}") for a in "xy"]
    length = F.aggregate("edges", F.lit(0.0), lambda s, e: s + F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))
    return staged(
        alike.orderBy(*ORDER).select(F.monotonically_increasing_id().alias("id"), *ORDER, "edges", *extent, length.alias("length"))
    )


def _fine(found: Row, size: float) -> float:
    """The size halved until about BORDERS edges cross a cell, at most HALVINGS times."""
    if not found["length"]:
        return size
    crowd = found["length"] * size / _plane(found, size) / BORDERS
    return size / 2 ** min(HALVINGS, max(0, math.ceil(math.log2(crowd))))


def _plane(found: Row, size: float) -> float:
    return max(found["hi_x"] - found["lo_x"], size) * max(found["hi_y"] - found["lo_y"], size)


def _parts(regions: DataFrame, count: int, fine: float, first: float) -> list[DataFrame]:
    """The regions in their order, in parts: the first takes about ``first`` cells, and with each
    further part the cells taken grow GROWTH times."""
    block = max(0, math.ceil(math.log2(max(count, 1) / BLOCKS)))
    cells = F.size("edges") + F.col("length") * (2 / fine) + F.coalesce("area", F.lit(0.0)) / fine**2
    found = regions.groupBy(F.shiftright("id", block).alias("block")).agg(F.sum(cells).alias("cells")).orderBy("block").collect()
    ends, total = [], 0.0
    for row in found:
        total += row["cells"]
        if total >= first:
            ends.append((row["block"] + 1) << block)
            first = max(first, total) * GROWTH
    starts = [0, *ends]
    if found and starts[-1] == (found[-1]["block"] + 1) << block:
        ends[-1] = None
        starts.pop()
    else:
        ends.append(None)
    return [
        regions.filter(F.col("id") >= a) if b is None else regions.filter(F.col("id").between(a, b - 1))
        for a, b in zip(starts, ends, strict=True)
    ]


def _touching(regions: DataFrame, cells: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """The regions whose extent, widened by ``margin``, meets one of ``cells``, with the rows of those
    (``only``). Each asks on a level of cells, doubled so often that three in a row hold it."""
    side = F.greatest(F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y")) + 2 * margin
    level = F.greatest(F.lit(0), F.ceil(F.log2(side / size)) - 1).cast("int")
    wide = margin + size * SLACK
    bounds = {n: _cell(F.col(n) + (wide if n.startswith("hi") else -wide), size) for n in ("lo_x", "lo_y", "hi_x", "hi_y")}
    boxes = regions.select("id", level.alias("level"), *[c.alias(n) for n, c in bounds.items()])
    found = boxes.agg(F.min("level").alias("low"), F.max("level").alias("high")).first()
    if found["low"] is None:
        return regions.withColumn("only", F.array("id"))  # there are none
    levels = cells.withColumn("level", F.explode(F.sequence(F.lit(found["low"]), F.lit(found["high"]))))
    up = [F.expr(f"shiftright(c{a}, level)").alias(f"c{a}") for a in "xy"]
    held = levels.select("level", *up, F.col("cy").alias("row")).distinct()
    for a in "xy":
        boxes = boxes.withColumn(f"c{a}", F.explode(F.expr(f"sequence(shiftright(lo_{a}, level), shiftright(hi_{a}, level))")))
    meeting = boxes.join(held, ["level", "cx", "cy"]).filter(F.col("row").between(F.col("lo_y"), F.col("hi_y")))
    return regions.join(meeting.groupBy("id").agg(F.collect_set("row").alias("only")), "id")


def _region_rows(regions: DataFrame, fine: float) -> DataFrame:
    """For each region and row of cells its edges there, the cells they cross (``crossed``) and where
    they meet the middle of the row (``turns``)."""
    e, middle = F.col("e"), (F.col("cy") + 0.5) * fine
    turn = F.when((e["y1"] > middle) != (e["y2"] > middle), _at(middle))
    kept = [c for c in ("id", "only") if c in regions.columns]
    edges = spread_evenly(regions.select(*kept, "edges"), "id").select(*kept, F.explode("edges").alias("e"))
    rows = _in_rows(edges, fine, 0.0)
    return rows.groupBy("id", "cy").agg(
        F.collect_list("e").alias("edges"),
        F.array_distinct(F.flatten(F.collect_list(F.sequence("a", "b")))).alias("crossed"),
        F.array_sort(F.collect_list(turn)).alias("turns"),
    )


def _whole(rows: DataFrame, fine: float) -> DataFrame:
    """For each cell how many of the regions cover it whole, and the first of them: a cell without an
    edge is inside where an odd number of turns follows, and never before the first crossed cell."""
    even = "if(size(turns) % 2 = 1, concat(array((array_min(crossed) + 0.5) * {0}), turns), turns)".format(f"{fine!r}D")
    spans = f"""
        transform(filter(sequence(0, size(turns)), i -> i % 2 = 1 and i < size(turns)), i ->
            struct(floor(turns[i - 1] / {fine!r}D - 0.5) + 1 as a, ceil(turns[i] / {fine!r}D - 0.5) - 1 as b))
    """
    cells = "array_except(flatten(transform(filter(spans, s -> s.a <= s.b), s -> sequence(s.a, s.b))), crossed)"
    found = rows.select("id", "cy", "crossed", F.expr(even).alias("turns")).select("id", "cy", "crossed", F.expr(spans).alias("spans"))
    each = found.select("id", "cy", F.explode(F.expr(cells)).alias("cx"))
    return each.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("inside"), F.min("id").alias("first"))


def grid_index(
    regions: DataFrame, size: float = CELL, near: float = NEAR_REGION_DEGREES, asked: DataFrame | None = None
) -> GridIndex:
    """The index of a layer. Of the regions that cover a cell only their number and the first count,
    and under two or more of them only border candidates that come before it.

    With ``asked`` (x, y: the points that will be looked up) the regions come in parts, the smallest
    first. Of later parts, only what is in a row with a cell of points that fewer than two before them
    cover is cut into cells.
    """
    numbered = _numbered(regions)
    found = numbered.agg(
        F.count(F.lit(1)).alias("count"), F.sum("length").alias("length"),
        *[f(f"{n}_{a}").alias(f"{n}_{a}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max))],
    ).first()
    fine = _fine(found, size)
    wanted, parts = None, [numbered]
    if asked is not None and found["count"]:
        cells = asked.select(_cell(F.col("x"), fine).alias("cx"), _cell(F.col("y"), fine).alias("cy"))
        wanted = staged(cells.dropna().distinct())
        few, many = FIRST
        parts = _parts(numbered, found["count"], fine, min(max(few, 16 * _plane(found, size) / fine**2), many))
    rows, inside, still = [], None, wanted
    for part in parts:
        if inside is not None:
            part = _touching(part, still, fine)
        rows.append(staged(_region_rows(part, fine)))
        whole = _whole(rows[-1], fine)
        if wanted is not None:
            whole = whole.join(wanted, ["cx", "cy"], "left_semi")
        if inside is not None:
            whole = inside.unionByName(whole).groupBy("cx", "cy").agg(F.sum("inside").alias("inside"), F.min("first").alias("first"))
        inside = staged(whole)
        if wanted is not None:
            still = staged(wanted.join(inside.filter("inside > 1"), ["cx", "cy"], "left_anti"))
            if still.isEmpty():
                break
    in_row = reduce(DataFrame.unionByName, rows)
    crossed = in_row.select("id", "cy", F.explode("crossed").alias("cx"))
    if wanted is not None:
        crossed = crossed.join(wanted, ["cx", "cy"], "left_semi")
    candidates = crossed.join(inside, ["cx", "cy"], "left").filter((F.coalesce("inside", F.lit(0)) < 2) | (F.col("id") < F.col("first")))
    # An edge left of a cell is never to the right of a point in it, one beyond it through the whole row always is.
    left, right, bottom, top = [(F.col(c) + d) * fine for c, d in (("cx", -SLACK), ("cx", 1 + SLACK), ("cy", -SLACK), ("cy", 1 + SLACK))]

    def beyond(e: Column) -> Column:
        through = (F.least(e["y1"], e["y2"]) < bottom) & (F.greatest(e["y1"], e["y2"]) > top)
        return through & (F.least(e["x1"], e["x2"]) > right)

    reaching = F.filter("edges", lambda e: (F.greatest(e["x1"], e["x2"]) >= left) & ~beyond(e))
    names = numbered.select("id", *ORDER)
    border = (
        candidates.select("id", "cx", "cy").join(in_row.select("id", "cy", "edges"), ["id", "cy"])
        .select("id", "cx", "cy", reaching.alias("edges"), F.size(F.filter("edges", beyond)).alias("beyond")).join(names, "id")
        .groupBy("cx", "cy").agg(F.collect_list(F.struct("name", "rank", "area", "edges", "beyond")).alias("border"))
    )
    best = inside.join(names.withColumnRenamed("id", "first"), "first").select("cx", "cy", "inside", F.struct(*ORDER).alias("best"))
    bare = None if wanted is None else staged(wanted.join(inside, ["cx", "cy"], "left_anti"))
    return GridIndex(staged(best.join(border, ["cx", "cy"], "full")), numbered, fine, near, bare)


def _around(index: GridIndex, cells: DataFrame, size: float) -> DataFrame:
    """For each of ``cells`` the edges within ``near`` degrees of it, by region."""
    region = ["id", "name", "rank"]
    edges = _touching(index.regions, cells, size, index.near).select(*region, "only", F.explode("edges").alias("e"))
    found = _in_rows(edges, size, index.near).select(*region, "e", "cy", F.explode(F.sequence("a", "b")).alias("cx"))
    by_region = found.join(cells, ["cx", "cy"], "left_semi").groupBy(*region, "cx", "cy").agg(F.collect_list("e").alias("edges"))
    return by_region.groupBy("cx", "cy").agg(F.collect_list(F.struct("name", "rank", "edges")).alias("around"))


def with_layer_region(
    frame: DataFrame, index: GridIndex, size: float = CELL, near: float = NEAR_REGION_DEGREES,
    lat: str = "latitude", lon: str = "longitude",
) -> DataFrame:
    """Add ``_region`` struct(name, confidence): the smallest region that covers the point, else the
    nearest within ``near`` degrees, equals by rank. ``frame`` is read twice, first its places only."""
    x, y = F.col(lon), F.col(lat)
    names = {"cx": "_cx", "cy": "_cy", "inside": "_inside", "best": "_best", "border": "_border"}
    covering = index.covering.withColumnsRenamed(names)

    def celled(points: DataFrame) -> DataFrame:
        return points.withColumns({"_cx": _cell(x, index.fine), "_cy": _cell(y, index.fine)})

    # Only points that nothing covers meet the edges around them; the others get keys, spread out, that no cell has.
    places = celled(frame.select(lat, lon).dropna())
    if index.bare is not None:
        places = places.join(index.bare.withColumnsRenamed(names), ["_cx", "_cy"], "left_semi")
    bare = places.join(covering.filter("_inside is null"), ["_cx", "_cy"], "left").filter(
        ~F.coalesce(F.exists("_border", lambda c: covers(c["edges"], c["beyond"], x, y)), F.lit(False))
    )
    if index.bare is None:
        bare = bare.join(covering.filter("_inside > 0"), ["_cx", "_cy"], "left_anti")
    open_cells = staged(bare.select(_cell(x, size).alias("cx"), _cell(y, size).alias("cy")).distinct())
    near_by = staged(_around(index, open_cells, size)).withColumnsRenamed({"cx": "_cx", "cy": "_cy"})
    hits = F.transform(
        F.filter("_border", lambda c: covers(c["edges"], c["beyond"], x, y)), lambda c: F.struct(c["area"], c["rank"], c["name"])
    )
    # The tests are columns of their own, so that the rules below do not repeat them.
    tested = celled(frame).join(covering, ["_cx", "_cy"], "left").select(*frame.columns, "_inside", "_best", hits.alias("_found")).select(
        *frame.columns,
        (F.coalesce("_inside", F.lit(0)) + F.coalesce(F.size("_found"), F.lit(0))).alias("_hits"),
        F.least("_best", F.array_min("_found"))["name"].alias("_smallest"),
    )
    covered = F.col("_hits") > 0
    apart = F.pmod(F.xxhash64(x, y), F.lit(1024)) + (1 << 40)
    asking = tested.withColumns({"_cx": _cell(x, size), "_cy": F.when(covered, apart).otherwise(_cell(y, size))})
    nearest = F.array_min(F.transform("around", lambda c: F.struct(distance(c["edges"], x, y).alias("d"), c["rank"], c["name"])))
    placed = asking.join(near_by, ["_cx", "_cy"], "left").select(*frame.columns, "_hits", "_smallest", nearest.alias("_near"))

    def answer(name: Column, kind: str) -> Column:
        return F.struct(name.alias("name"), F.lit(REGION_CONFIDENCE[kind]).alias("confidence"))

    smallest = F.col("_smallest")
    chain = (
        F.when(x.isNull() | y.isNull(), answer(F.lit(UNCLASSIFIED_REGION), "missing"))
        .when(F.col("_hits") == 1, answer(smallest, "single"))
        .when(F.col("_hits") > 1, answer(smallest, "overlap"))
        .when(F.col("_near.d") <= near, answer(F.col("_near.name"), "near"))
        .otherwise(answer(F.lit(OUTSIDE_REGION), "outside"))
    )
    return placed.select(*frame.columns, chain.alias("_region"))


def classify_by_layer(events: DataFrame, regions: DataFrame, size: float = CELL) -> DataFrame:
    """``classify_events`` with a layer (see ``layer``) in place of the two configured regions."""
    events = conform(events)
    index = grid_index(regions, size, asked=events.select(F.col("longitude").alias("x"), F.col("latitude").alias("y")))
    return conform(
        with_layer_region(events, index, size).withColumns(
            {"tectonic_domain": F.col("_region.name"), "domain_confidence": F.col("_region.confidence")}
        )
    )
