"""Skew-proof primitives: running totals, global row numbers, exact quantiles,
expanding ranks and connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.session import staged


def running_totals(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    measures: dict[str, Column],
    partitions: int | None = None,
) -> DataFrame:
    """Inclusive running sums per key, exact for a key of any size.

    A window would sort each key in one task. Here rows are range-partitioned
    by (keys, order), so a hot key spreads over many tasks; each partition
    sums on its own and takes an offset from the partitions before it. The
    range-partitioned rows are staged so that partition ids stay fixed. ``order``
    must be total within a key for a deterministic result.
    """
    spark = frame.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key_columns = [F.col(k) for k in keys]
    named = frame.select("*", *[m.alias(f"_m_{n}") for n, m in measures.items()])
    placed = staged(
        named.repartitionByRange(count, *key_columns, *order).withColumn(
            "_pid", F.spark_partition_id()
        )
    )
    totals = placed.groupBy(*keys, "_pid").agg(
        *[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in measures]
    )
    # Rows here: one per (key, partition); per key at most `count`.
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *keys,
        "_pid",
        *[
            F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}")
            for n in measures
        ],
    )
    spanning = offsets.filter(
        " or ".join(f"_o_{n} <> 0" for n in measures)
    )
    inside = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    local = placed.select(
        *frame.columns,
        "_pid",
        *[F.sum(f"_m_{n}").over(inside).alias(f"_l_{n}") for n in measures],
    )
    # Only keys that cross a partition border have an offset: fewer than
    # `count` rows, whatever the data size.
    joined = local.join(F.broadcast(spanning), ["_pid", *keys], "left")
    return joined.select(
        *frame.columns,
        *[
            (F.col(f"_l_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n)
            for n in measures
        ],
    )


def global_row_number(frame: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1-based position in a total order, without a one-task window."""
    return running_totals(
        frame.withColumn("_all", F.lit(0)), ["_all"], order, {name: F.lit(1).cast("long")}
    ).drop("_all")


def weighted_quantiles(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    bucket_width: float,
    quantiles: dict[str, float],
) -> DataFrame:
    """Exact linear-interpolation quantiles per key of weighted values.

    Two levels: sums per bucket of ``bucket_width`` find the bucket of each
    wanted rank, then only rows of those buckets are sorted. Both levels
    combine on the map side, and a key's rows never meet in one task.
    """
    keys = list(keys)
    data = frame.select(
        *keys,
        F.col(value).cast("double").alias("_v"),
        F.col(weight).cast("long").alias("_w"),
    ).filter("_v is not null and _w > 0")
    data = data.withColumn("_b", F.floor(F.col("_v") / F.lit(float(bucket_width))))
    buckets = data.groupBy(*keys, "_b").agg(F.sum("_w").alias("_bw"))
    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ranked = buckets.select(
        *keys,
        "_b",
        "_bw",
        F.sum("_bw").over(upto).alias("_hi"),
        F.sum("_bw").over(by_key).alias("_n"),
    )
    wanted = ranked.withColumn(
        "_q",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q"))
                    for n, q in quantiles.items()
                ]
            )
        ),
    ).select(
        *keys, "_b", "_hi", F.col("_hi") - F.col("_bw"), "_n", "_q.name",
        (F.col("_q.q") * (F.col("_n") - 1)).alias("_pos"),
    ).toDF(*keys, "_b", "_hi", "_lo", "_n", "_name", "_pos")
    low, high = F.floor("_pos"), F.ceil("_pos")
    wanted = wanted.filter(
        ((low >= F.col("_lo")) & (low < F.col("_hi")))
        | ((high >= F.col("_lo")) & (high < F.col("_hi")))
    )
    targets = wanted.groupBy(*keys, "_b", "_lo").agg(
        F.collect_list(F.struct("_name", "_pos")).alias("_asked")
    )
    values = (
        data.join(targets.select(*keys, "_b"), [*keys, "_b"], "left_semi")
        .groupBy(*keys, "_b", "_v")
        .agg(F.sum("_w").alias("_w"))
    )
    within = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, 0
    )
    placed = values.withColumn("_cum", F.sum("_w").over(within)).join(targets, [*keys, "_b"])
    end = F.col("_lo") + F.col("_cum")
    picked = placed.select(
        *keys, "_v", (end - F.col("_w")).alias("_s"), end.alias("_e"), F.explode("_asked").alias("_a")
    ).select(*keys, "_v", "_s", "_e", "_a._name", "_a._pos")
    low, high = F.floor("_pos"), F.ceil("_pos")
    return picked.groupBy(*keys).agg(
        *[
            _interpolated(n, low, high).alias(n)
            for n in quantiles
        ]
    )


def _interpolated(name: str, low: Column, high: Column) -> Column:
    mine = F.col("_name") == name
    v, s, e, pos = F.col("_v"), F.col("_s"), F.col("_e"), F.col("_pos")
    at_low = F.max(F.when(mine & (low >= s) & (low < e), v))
    at_high = F.max(F.when(mine & (high >= s) & (high < e), v))
    share = F.max(F.when(mine, pos - low))
    return at_low + (at_high - at_low) * share


def prior_not_greater(
    frame: DataFrame, keys: Sequence[str], order: str, value: str, name: str
) -> DataFrame:
    """For each row: how many earlier rows of the key have value <= its own.

    The relational form of an order-statistics tree. Rows are numbered in
    time; at level l, rows of an even block of 2^l insert and rows of the odd
    block next to it ask. Every (earlier, later) pair meets at exactly one
    level, so log2(n) sorted passes over n rows replace n^2 comparisons, and
    only the top levels see a whole key. Keys are calendar-bounded series (one
    row per step of the grid).
    """
    keys = list(keys)
    by_key = Window.partitionBy(*keys)
    numbered = frame.filter(F.col(value).isNotNull()).select(
        *keys,
        F.col(order).alias("_o"),
        F.col(value).alias("_v"),
        (F.row_number().over(by_key.orderBy(order)) - 1).cast("long").alias("_r"),
        F.count(F.lit(1)).over(by_key).alias("_n"),
    )
    level = F.expr("explode(sequence(0, cast(floor(log2(_n)) as int)))").alias("_l")
    spread = numbered.select("*", level).select(
        *keys, "_o", "_v", "_l", F.expr("shiftright(_r, _l)").alias("_block")
    )
    spread = spread.withColumn("_asks", F.col("_block") % 2)
    node = Window.partitionBy(*keys, "_l", F.expr("shiftright(_block, 1)")).orderBy(
        "_v", "_asks"
    ).rowsBetween(Window.unboundedPreceding, 0)
    counted = spread.withColumn("_below", F.sum(1 - F.col("_asks")).over(node))
    asked = counted.groupBy(*keys, "_o").agg(
        F.sum(F.when(F.col("_asks") == 1, F.col("_below")).otherwise(0)).alias("_c")
    )
    ranks = numbered.select(*keys, "_o", "_r").join(asked, [*keys, "_o"], "left").select(
        *keys, F.col("_o").alias(order), F.coalesce("_c", F.lit(0)).cast("long").alias(name)
    )
    return frame.join(ranks, [*keys, order], "left")


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest member per node of an undirected graph (columns a, b).

    Alternating large-star and small-star rounds (Kiveris et al., 2014): the
    diameter of the graph does not set the number of rounds. Neighbour minima
    are plain aggregates with a map-side combine, so a hub is never collected.
    Returns (node, component).
    """
    current = staged(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v")
        .distinct()
    )
    previous = None
    while True:  # each round shrinks the graph towards stars, which no round changes
        # large star: connect larger neighbours to the smallest of {node, neighbours}
        both = current.union(current.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m")
        )
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct()
        )
        # small star: connect smaller-or-equal neighbours to the smallest
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least_down = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(least_down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least_down.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct()
        )
        current = staged(small)
        state = current.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if previous == (state["n"], state["h"]):
            break
        previous = (state["n"], state["h"])
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(roots)


def relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (a, b) between labels (node, component); a node without one keeps its name, loops go."""
    out = edges
    for end in ("a", "b"):
        named = labels.select(F.col("node").alias(end), F.col("component").alias("_label"))
        out = out.join(named, end, "left").withColumn(end, F.coalesce("_label", end)).drop("_label")
    return out.filter("a <> b")


def merged_components(edges: DataFrame) -> DataFrame:
    """One member of its component per node of an undirected graph (columns a, b).

    For graphs with many more edges than nodes: each round merges a node into the neighbour (or itself) of least hash, a new
    hash each time, and draws the edges again between what is left. The graph
    shrinks by a constant factor, in a dense one by its degree, so that all
    rounds cost about as much as the first, whatever the diameter. Choices are
    plain aggregates with a map-side combine, so a hub is never collected.
    Returns (node, component).
    """
    current = staged(edges.select("a", "b").filter("a <> b").distinct())
    rounds: list[DataFrame] = []
    while not rounds or not current.isEmpty():
        both = current.union(current.select("b", "a")).toDF("node", "other")
        seed = F.lit(len(rounds))
        rank, own = F.xxhash64("other", seed), F.xxhash64("node", seed)
        chosen = both.groupBy("node").agg(F.min(rank).alias("_rank"), F.min_by("other", rank).alias("_other"))
        rounds.append(
            staged(chosen.select("node", F.when(F.col("_rank") < own, F.col("_other")).otherwise(F.col("node")).alias("component")))
        )
        left = relabelled(current, rounds[-1]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        current = staged(left.distinct())
    roots = rounds.pop()
    while rounds:
        after = roots.select(F.col("node").alias("component"), F.col("component").alias("_root"))
        roots = rounds.pop().join(after, "component", "left").select(
            "node", F.coalesce("_root", "component").alias("component")
        )
    return roots
