"""Mainshock / associated-event separation with the exact greedy outcome.

The sequential rule visits candidates from the largest magnitude down; an
unclaimed candidate claims every unclaimed later event in its space-time
window. Equivalently: a candidate stays active unless an active candidate of
higher priority covers it, and each event belongs to the first active
candidate that covers it. Rounds of semi/anti joins settle the candidates:
those covered by no undecided candidate become active, and what they cover is
settled too. Existence joins never emit the pairs of a dense spot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.fixed_values import DECLUSTER_METHOD
from quakeloom.functions.scalar import (
    cube_xyz,
    haversine_km,
    spatial_window_km,
    temporal_window_days,
)
from quakeloom.operators.distributed import global_row_number
from quakeloom.operators.magnitude import is_background, is_preferred
from quakeloom.schema import conform
from quakeloom.session import staged, with_row_key

DAY_US = 86_400_000_000
CLASS_BREAKS = (3.5, 4.0, 4.5, 5.0, 5.5)  # grid resolutions; any breaks give the same result


@dataclass(frozen=True)
class DeclusterParameters:
    minimum_mainshock_magnitude: float = 3.0
    minimum_radius_km: float = 12.0
    maximum_radius_km: float = 180.0
    minimum_window_days: float = 1.0
    maximum_window_days: float = 365.0

    def radius(self, magnitude: float) -> float:
        return min(max(10 ** (0.5 * magnitude - 0.75), self.minimum_radius_km), self.maximum_radius_km)

    def days(self, magnitude: float) -> float:
        return min(max(10 ** (0.8 * magnitude - 1.2), self.minimum_window_days), self.maximum_window_days)

    def classes(self) -> list[tuple[int, float, float, float]]:
        """(class, upper magnitude, largest radius km, largest window us)."""
        tops = [*CLASS_BREAKS, math.inf]
        return [
            (
                k,
                top,
                self.maximum_radius_km if math.isinf(top) else self.radius(top),
                (self.maximum_window_days if math.isinf(top) else self.days(top)) * DAY_US,
            )
            for k, top in enumerate(tops)
        ]


def exclusion_reason() -> Column:
    missing = F.concat_ws(
        "_",
        F.when(F.col("origin_time_utc").isNull(), "data"),
        F.when(F.col("latitude").isNull() | F.col("longitude").isNull(), "coordenadas"),
        F.when(F.col("magnitude_comparable").isNull(), "magnitude"),
    )
    return F.when(missing == "", "eligible").otherwise(F.concat(F.lit("missing_"), missing))


def _magnitude_class(magnitude: Column) -> Column:
    chain = F.when(magnitude < CLASS_BREAKS[0], 0)
    for k, top in enumerate(CLASS_BREAKS[1:], start=1):
        chain = chain.when(magnitude < top, k)
    return chain.otherwise(len(CLASS_BREAKS))


class Cover:
    """Grid keys under which a covering candidate meets what it may cover.

    Per magnitude class the cell is two radii wide and one window long, so a
    window touches at most two cells per axis.
    """

    AXES = ("x", "y", "z", "t")

    def __init__(self, parameters: DeclusterParameters):
        self.parameters = parameters

    def _sizes(self, radius: float, window: float) -> tuple[float, float, float, float]:
        side = 2 * radius
        return side, side, side, window

    def _struct(self, k: int, indices: list[Column]) -> Column:
        names = ("kx", "ky", "kz", "kt")
        return F.struct(F.lit(k).alias("kc"), *[i.cast("long").alias(n) for i, n in zip(indices, names)])

    def coverer_key(self, frame: DataFrame) -> DataFrame:
        """One key per covering row, at the resolution of its class."""
        key = None
        for k, _, radius, window in self.parameters.classes():
            cells = [F.floor(F.col(a) / s) for a, s in zip(self.AXES, self._sizes(radius, window))]
            here = self._struct(k, cells)
            key = F.when(F.col("class") == k, here) if key is None else key.when(F.col("class") == k, here)
        return frame.withColumn("_k", key).select("*", "_k.*").drop("_k")

    def covered_search(self, frame: DataFrame) -> DataFrame:
        """All cells in which some coverer of a row may lie."""
        return self._spread(frame, backwards=True)

    def covered_key(self, frame: DataFrame) -> DataFrame:
        """One key per class for each row that may be covered."""
        keys = []
        for k, top, radius, window in self.parameters.classes():
            cells = [F.floor(F.col(a) / s) for a, s in zip(self.AXES, self._sizes(radius, window))]
            keys.append(F.when(F.col("m") <= top, self._struct(k, cells)))
        return (
            frame.withColumn("_k", F.explode(F.array_compact(F.array(*keys))))
            .select("*", "_k.*").drop("_k")
        )

    def coverer_reach(self, frame: DataFrame) -> DataFrame:
        """All cells that the window of a covering row may touch."""
        return self._spread(frame, backwards=False)

    def _spread(self, frame: DataFrame, backwards: bool) -> DataFrame:
        choices = []
        for k, top, radius, window in self.parameters.classes():
            reach = radius * (1 + 1e-9) + 1e-6
            ranges = []
            for axis, size in zip(self.AXES, self._sizes(radius, window)):
                at = F.col(axis)
                if axis == "t":
                    low, high = (at - window, at) if backwards else (at, at + window)
                else:
                    low, high = at - reach, at + reach
                ranges.append(F.sequence(F.floor(low / size), F.floor(high / size)))
            wanted = (F.col("m") <= top) if backwards else (F.col("class") == k)
            choices.append(
                F.when(
                    wanted,
                    F.struct(
                        F.lit(k).alias("kc"),
                        *[r.alias(n) for r, n in zip(ranges, ("rx", "ry", "rz", "rt"))],
                    ),
                )
            )
        out = frame.withColumn("_s", F.explode(F.array_compact(F.array(*choices))))
        out = out.withColumn("kc", F.col("_s.kc"))
        for n, r in (("kx", "rx"), ("ky", "ry"), ("kz", "rz"), ("kt", "rt")):
            out = out.withColumn(n, F.explode(F.col(f"_s.{r}")))
        return out.drop("_s")

    def condition(self, c: str, e: str) -> Column:
        """c covers e: same grid key, later by at most the window, near, and
        not larger."""
        keys = F.lit(True)
        for k in ("kc", "kx", "ky", "kz", "kt"):
            keys = keys & (F.col(f"{c}.{k}") == F.col(f"{e}.{k}"))
        delta = (F.col(f"{e}.t") - F.col(f"{c}.t")) / F.lit(float(DAY_US))
        return (
            keys
            & (delta > 0)
            & (delta <= F.col(f"{c}.days"))
            & (F.col(f"{e}.m") <= F.col(f"{c}.m"))
            & (
                haversine_km(
                    F.col(f"{c}.lat"), F.col(f"{c}.lon"), F.col(f"{e}.lat"), F.col(f"{e}.lon")
                )
                <= F.col(f"{c}.radius")
            )
        )


def _frontier(undecided: DataFrame, parameters: DeclusterParameters) -> DataFrame:
    """Undecided rows minus those surely covered by an undecided row nearby.

    Two rows in one small cube and within the shortest window: the later,
    not larger one is covered by the earlier one. Minute champions and their
    running maximum over a day find such rows with bounded windows.
    """
    side = parameters.minimum_radius_km / math.sqrt(3) * 0.99
    span = int(parameters.minimum_window_days * DAY_US)
    slot = max(span // 1440, 1)
    placed = undecided.withColumns(
        {
            "cx": F.floor(F.col("x") / side),
            "cy": F.floor(F.col("y") / side),
            "cz": F.floor(F.col("z") / side),
            "slot": F.floor(F.col("t") / F.lit(slot)),
            "span": F.floor(F.col("t") / F.lit(span)),
        }
    )
    cube = ["cx", "cy", "cz", "span"]
    champions = placed.groupBy(*cube, "slot").agg(
        F.min(F.struct((-F.col("m")).alias("neg"), F.col("t"))).alias("best")
    )
    before = Window.partitionBy(*cube).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    champions = champions.select(
        *cube,
        "slot",
        (-F.col("best.neg")).alias("top_m"),
        F.col("best.t").alias("top_t"),
        F.max(-F.col("best.neg")).over(before).alias("earlier_m"),
    )
    sure = (F.col("earlier_m") >= F.col("m")) | (
        (F.col("top_m") >= F.col("m")) & (F.col("top_t") < F.col("t"))
    )
    return (
        placed.join(champions, [*cube, "slot"])
        .filter(~F.coalesce(sure, F.lit(False)))
        .select(*undecided.columns)
    )


def active_candidates(candidates: DataFrame, parameters: DeclusterParameters) -> DataFrame:
    """Candidates that no active candidate of higher priority covers."""
    cover = Cover(parameters)
    columns = candidates.columns
    undecided = candidates
    active = None
    while True:
        front = _frontier(undecided, parameters)
        blocked = (
            cover.covered_search(front).alias("e")
            .join(cover.coverer_key(undecided).alias("c"), cover.condition("c", "e"), "left_semi")
            .select("nid")
        )
        chosen = staged(front.join(blocked, "nid", "left_anti").select(*columns))
        active = chosen if active is None else active.union(chosen)
        claimed = (
            cover.covered_key(undecided).alias("e")
            .join(cover.coverer_reach(chosen).alias("c"), cover.condition("c", "e"), "left_semi")
            .select("nid")
        )
        undecided = staged(
            undecided.join(chosen.select("nid").union(claimed), "nid", "left_anti").select(*columns)
        )
        if undecided.isEmpty():
            return active


def annotate_declustering(
    frame: DataFrame, parameters: DeclusterParameters | None = None
) -> DataFrame:
    """Role, cluster and background flag for every record."""
    parameters = parameters or DeclusterParameters()
    cover = Cover(parameters)
    reason = F.when(~is_preferred(), "redundant_source_record").otherwise(exclusion_reason())
    records = with_row_key(
        conform(frame)
        .withColumn("declustering_exclusion_reason", reason)
        .withColumn("declustering_eligible", F.col("declustering_exclusion_reason") == "eligible")
        .withColumn("declustering_method", F.lit(DECLUSTER_METHOD))
    )
    eligible = records.filter("declustering_eligible").select(
        F.unix_micros("origin_time_utc").alias("t"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        F.col("magnitude_comparable").alias("m"),
        "event_id",
        "_row",
    )
    # Copies (same time, place and size) share one node; only the first copy
    # can claim anything, the others are claimed together with it or not at all.
    x, y, z = cube_xyz(F.col("lat"), F.col("lon"))
    nodes = staged(
        eligible.groupBy("t", "lat", "lon", "m")
        .agg(F.min(F.struct("event_id", "_row")).alias("_first"))
        .select(
            "t", "lat", "lon", "m",
            F.col("_first.event_id").alias("eid"), F.col("_first._row").alias("nid"),
            x.alias("x"), y.alias("y"), z.alias("z"),
        )
    )
    candidates = nodes.filter(F.col("m") >= parameters.minimum_mainshock_magnitude).withColumns(
        {
            "class": _magnitude_class(F.col("m")),
            "radius": spatial_window_km(
                F.col("m"), parameters.minimum_radius_km, parameters.maximum_radius_km
            ),
            "days": temporal_window_days(
                F.col("m"), parameters.minimum_window_days, parameters.maximum_window_days
            ),
        }
    )
    active = active_candidates(candidates, parameters)
    claims = staged(
        cover.covered_key(nodes).alias("e")
        .join(cover.coverer_reach(active).alias("c"), cover.condition("c", "e"))
        .select(
            F.col("e.nid").alias("nid"),
            F.struct(
                (-F.col("c.m")).alias("p1"), F.col("c.t").alias("p2"),
                F.col("c.eid").alias("p3"), F.col("c.nid").alias("main"),
            ).alias("by"),
        )
        .groupBy("nid")
        .agg(F.min("by").alias("by"))
        .select("nid", F.col("by.main").alias("main"))
    )
    mainshocks = active.select("nid", "m", "t", "eid").join(
        claims.select(F.col("main").alias("nid")).distinct(), "nid"
    )
    numbered = global_row_number(
        mainshocks, [F.desc("m"), F.asc("t"), F.asc("eid"), F.asc("nid")], "_seq"
    ).select(
        F.col("nid").alias("main"),
        F.format_string("SEQ-%06d", F.col("_seq")).alias("_cluster"),
    )
    assigned = (
        claims.join(numbered, "main")
        .select("nid", "_cluster", F.lit(False).alias("_is_main"))
        .union(numbered.select(F.col("main"), "_cluster", F.lit(True)))
    )
    node_result = nodes.select("t", "lat", "lon", "m", "nid").join(assigned, "nid")
    joined = records.join(
        node_result,
        F.col("declustering_eligible")
        & (F.unix_micros("origin_time_utc") == F.col("t"))
        & (F.col("latitude") == F.col("lat"))
        & (F.col("longitude") == F.col("lon"))
        & (F.col("magnitude_comparable") == F.col("m")),
        "left",
    )
    main_here = F.coalesce(F.col("_is_main") & (F.col("_row") == F.col("nid")), F.lit(False))
    claimed_here = F.coalesce(~F.col("_is_main"), F.lit(False))
    role = (
        F.when(F.col("declustering_exclusion_reason") == "redundant_source_record", "redundant_record")
        .when(~F.col("declustering_eligible"), "ineligible")
        .when(main_here, "mainshock")
        .when(claimed_here, "associated_event")
        .otherwise("background")
    )
    return conform(
        joined.withColumn("cluster_role", role).withColumns(
            {
                "cluster_id": F.when(main_here | claimed_here, F.col("_cluster")),
                "is_background_event": F.col("cluster_role").isin("background", "mainshock"),
            }
        )
    )


def declustering_summary(frame: DataFrame) -> DataFrame:
    """Reconciliation counts of the preferred population, one row."""

    def role(name: str) -> Column:
        return F.count_if(F.coalesce(F.col("cluster_role") == name, F.lit(False)))

    total = F.count(F.lit(1))
    eligible = F.count_if(F.coalesce("declustering_eligible", F.lit(False)))
    background = F.count_if(is_background())
    parts = background + role("associated_event") + role("ineligible") + role("unclassified")
    return frame.filter(is_preferred()).agg(
        total.alias("preferred_events"),
        eligible.alias("eligible_events"),
        background.alias("background_events"),
        role("associated_event").alias("associated_events"),
        role("mainshock").alias("mainshocks"),
        role("ineligible").alias("ineligible_events"),
        role("unclassified").alias("unclassified_events"),
        parts.alias("reconciled_events"),
        (total - parts).alias("reconciliation_gap"),
        F.count_distinct("cluster_id").alias("sequences"),
        F.coalesce(F.try_divide(background, total), F.lit(0.0)).alias("retained_fraction"),
        F.coalesce(F.try_divide(background, eligible), F.lit(0.0)).alias("retained_fraction_eligible"),
        F.lit(DECLUSTER_METHOD).alias("method"),
    )


def declustering_exclusion_summary(frame: DataFrame) -> DataFrame:
    return (
        frame.filter(is_preferred())
        .filter(~F.coalesce("declustering_eligible", F.lit(False)))
        .groupBy(F.coalesce("declustering_exclusion_reason", F.lit("unknown")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("records"))
        .orderBy(F.desc("records"), "reason")
    )
