"""Nearest historical states for many targets at once.

Every group below is the history of one target: windows of one region and one
width on the hop grid, so its size is bounded by the calendar (52 rows per
year at a weekly hop), never by the number of events.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.fixed_values import (
    COMPATIBILITY,
    COVERAGE_COLUMNS,
    FEATURE_WEIGHTS,
    REGIME_FEATURES,
    ROBUST_SPAN,
    SOURCE_SHARE_COLUMNS,
)
from quakeloom.functions.display import episode_id, interval_id
from quakeloom.functions.scalar import clip, weighted_geometric_mean
from quakeloom.session import spread_evenly, staged

DAY = 86400


@dataclass
class SimilarityResult:
    """Neighbours, per-feature explanation, targets and pool statistics, all
    keyed by ``query_id``."""

    neighbours: DataFrame
    feature_differences: DataFrame
    targets: DataFrame
    pools: DataFrame
    family_gap_days: int
    family_buffer_days: int


def targets_asof(fingerprints: DataFrame, queries: DataFrame) -> DataFrame:
    """Backward as-of: last window of the region that ends by ``target_end``
    (or the last window at all when it is NULL).

    The date is found on two columns; only the chosen windows bring the rest.
    """
    ends = fingerprints.select("tectonic_domain", "window_end")
    dated = (
        queries.alias("q")
        .join(
            ends.alias("f"),
            (F.col("q.tectonic_domain") == F.col("f.tectonic_domain"))
            & (F.col("q.target_end").isNull() | (F.col("f.window_end") <= F.col("q.target_end"))),
        )
        .groupBy("q.query_id", "q.tectonic_domain")
        .agg(F.max("f.window_end").alias("window_end"))
    )
    state = F.struct(*[F.col(f"f.{c}").alias(c) for c in fingerprints.columns])
    return (
        dated.alias("d")
        .join(fingerprints.alias("f"), ["tectonic_domain", "window_end"])
        .groupBy("query_id")
        .agg(F.first(state).alias("target"))
    )


def numeric_compatibility(value: Column, target: Column, default: float, scale: float) -> Column:
    return F.coalesce(F.exp(-F.abs(value - target) / max(scale, 1e-6)), F.lit(default))


def coverage_compatibility(pairs: Sequence[tuple[Column, Column]], default: float) -> Column:
    parts = [
        F.coalesce(clip(1.0 - F.abs(v - t), 0.05, 1.0), F.lit(default)) for v, t in pairs
    ]
    return sum(parts[1:], parts[0]) / len(parts)


def cosine_compatibility(pairs: Sequence[tuple[Column, Column]], default: float) -> Column:
    filled = [(F.coalesce(v, F.lit(0.0)), F.coalesce(t, F.lit(0.0))) for v, t in pairs]

    def total(terms: list[Column]) -> Column:
        return sum(terms[1:], terms[0])

    dot = total([v * t for v, t in filled])
    norm_v = F.sqrt(total([v * v for v, _ in filled]))
    norm_t = F.sqrt(total([t * t for _, t in filled]))
    cosine = F.when(norm_v * norm_t > 0, dot / (norm_v * norm_t)).otherwise(0.0)
    return F.when(norm_t == 0, F.lit(default)).otherwise(clip(cosine, 0.05, 1.0))


def comparability(value, target) -> dict[str, Column]:
    """Component scores and their weighted geometric mean."""
    scores = {
        name: numeric_compatibility(value(column), target(column), *COMPATIBILITY[name][1:])
        for name, column in (
            ("quality", "data_quality_score"),
            ("completeness", "catalogue_completeness_mc"),
            ("threshold", "comparison_magnitude_threshold"),
        )
    }
    scores["coverage"] = coverage_compatibility(
        [(value(c), target(c)) for c in COVERAGE_COLUMNS], COMPATIBILITY["coverage"][1]
    )
    scores["source_profile"] = cosine_compatibility(
        [(value(c), target(c)) for c in SOURCE_SHARE_COLUMNS], COMPATIBILITY["source_profile"][1]
    )
    overall = weighted_geometric_mean([(scores[n], COMPATIBILITY[n][0]) for n in scores])
    return {
        "comparability_score": clip(overall, 0.05, 1.0),
        **{f"{name}_compatibility": score for name, score in scores.items()},
    }


def winsor_bounds(quantiles: Column, lowest: Column, highest: Column) -> tuple[Column, Column]:
    """Limits from the 2.5 and 97.5 % quantiles, or all values if those are equal."""
    low, high = quantiles[0], quantiles[1]
    same = F.abs(low - high) <= F.abs(high) * 1e-5 + 1e-8
    return F.when(same, lowest).otherwise(low), F.when(same, highest).otherwise(high)


def robust_scale(quantiles: Column) -> tuple[Column, Column]:
    """Centre and scale from the 10, 50 and 90 % quantiles."""
    spread = quantiles[2] - quantiles[0]
    scale = F.when(spread < 10 * np.finfo(float).eps, F.lit(1.0)).otherwise(spread) / ROBUST_SPAN
    return quantiles[1], scale


def scaled_features(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Impute, winsorise and robust-scale a long table per key and feature.

    In: keys, feature, row, value, target. Out: usable features only, with z,
    target_z and the weight before normalisation.
    """
    keys = [*keys, "feature"]
    usable = (
        values.groupBy(*keys)
        .agg(
            F.count("value").alias("_n"),
            F.min("value").alias("_lo"),
            F.max("value").alias("_hi"),
            F.expr("percentile(value, 0.5)").alias("_median"),
        )
        .filter("_n >= 3 and _lo < _hi")
        .select(*keys, "_median")
    )
    filled = values.join(usable, keys).select(
        *values.columns,
        F.coalesce("value", "_median").alias("_x"),
        F.coalesce("target", "_median").alias("_t"),
    )
    tails = filled.groupBy(*keys).agg(
        F.expr("percentile(_x, array(0.025, 0.975))").alias("_q"),
        F.min("_x").alias("_min"),
        F.max("_x").alias("_max"),
    )
    low, high = winsor_bounds(F.col("_q"), F.col("_min"), F.col("_max"))
    tails = tails.select(*keys, low.alias("_low"), high.alias("_high"))

    def clipped(name: str) -> Column:
        return F.least(F.greatest(F.col(name), F.col("_low")), F.col("_high"))

    trimmed = filled.join(tails, keys).select(
        *values.columns, clipped("_x").alias("_x"), clipped("_t").alias("_t")
    )
    centre, size = robust_scale(F.col("_q"))
    scale = (
        trimmed.groupBy(*keys)
        .agg(F.expr("percentile(_x, array(0.1, 0.5, 0.9))").alias("_q"))
        .select(*keys, centre.alias("_centre"), size.alias("_scale"))
    )
    weight = F.lit(1.0)
    for name, w in FEATURE_WEIGHTS.items():
        weight = F.when(F.col("feature") == name, w).otherwise(weight)
    return trimmed.join(scale, keys).select(
        *values.columns,
        clip((F.col("_x") - F.col("_centre")) / F.col("_scale"), -6.0, 6.0).alias("z"),
        clip((F.col("_t") - F.col("_centre")) / F.col("_scale"), -6.0, 6.0).alias("target_z"),
        weight.alias("_weight"),
    )


def scaled_pairs(pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    """The scaling of ``scaled_features`` for rows that hold all features.

    In: query_id, columns of the caller, x<i> and t<i> for feature i of
    ``names`` in the row and in its target. Out: in their place ``_z`` and
    ``_target_z`` (NULL where a feature is not usable), ``_pool`` (rows of the
    query), ``_used`` (usable features) and ``_weights`` (normalised; NULL
    where not usable). One shuffle and one sort by query serve all its
    quantiles, and no row is repeated for a feature.
    """
    size = range(len(names))
    others = [c for c in pairs.columns if c not in {f"{k}{i}" for k in "xt" for i in size}]
    query = Window.partitionBy("query_id")

    def known(prefix: str, rule) -> list[Column]:
        return [F.expr(rule(i)).over(query).alias(f"{prefix}{i}") for i in size]

    counted = spread_evenly(pairs, "query_id").select(
        "*", F.count(F.lit(1)).over(query).alias("_pool"),
        *known("n", lambda i: f"count(x{i})"), *known("lo", lambda i: f"min(x{i})"),
        *known("hi", lambda i: f"max(x{i})"), *known("m", lambda i: f"percentile(x{i}, 0.5)"),
    )

    def filled(kind: str, i: int) -> Column:
        usable = (F.col(f"n{i}") >= 3) & (F.col(f"lo{i}") < F.col(f"hi{i}"))
        return F.when(usable, F.coalesce(f"{kind}{i}", f"m{i}")).alias(f"{kind}{i}")

    imputed = counted.select(*others, "_pool", *[filled(k, i) for k in "xt" for i in size]).select(
        "*", *known("q", lambda i: f"percentile(x{i}, array(0.025, 0.975))"),
        *known("lo", lambda i: f"min(x{i})"), *known("hi", lambda i: f"max(x{i})"),
    )

    def trimmed(kind: str, i: int) -> Column:
        low, high = winsor_bounds(F.col(f"q{i}"), F.col(f"lo{i}"), F.col(f"hi{i}"))
        return F.least(F.greatest(F.col(f"{kind}{i}"), low), high).alias(f"{kind}{i}")

    clipped = imputed.select(*others, "_pool", *[trimmed(k, i) for k in "xt" for i in size]).select(
        "*", *known("q", lambda i: f"percentile(x{i}, array(0.1, 0.5, 0.9))")
    )

    def scored(kind: str, i: int) -> Column:
        centre, scale = robust_scale(F.col(f"q{i}"))
        return clip((F.col(f"{kind}{i}") - centre) / scale, -6.0, 6.0)

    # clip() skips NULLs, so what is not usable is told by the value itself.
    used = [F.col(f"x{i}").isNotNull() for i in size]
    weight = [F.lit(float(FEATURE_WEIGHTS[n])) for n in names]
    count = sum([u.cast("int") for u in used], F.lit(0))
    total = sum([F.when(u, w).otherwise(0.0) for u, w in zip(used, weight, strict=True)], F.lit(0.0))
    return clipped.select(
        *others, "_pool", count.alias("_used"), (total / F.nullif(count, F.lit(0))).alias("_mean"),
        *[F.when(u, scored("x", i)).alias(f"x{i}") for i, u in enumerate(used)],
        *[F.when(u, scored("t", i)).alias(f"t{i}") for i, u in enumerate(used)],
    ).select(
        *others, "_pool", "_used",
        F.array(*[F.col(f"x{i}") for i in size]).alias("_z"),
        F.array(*[F.col(f"t{i}") for i in size]).alias("_target_z"),
        F.array(*[F.when(F.col(f"x{i}").isNotNull(), w / F.col("_mean")) for i, w in enumerate(weight)]).alias("_weights"),
    )


def _inverse_covariance(size: int):
    """Pseudo-inverse of a query's covariance; features it lacks get zeros."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        row = group.iloc[0]
        matrix = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)], float)
        known = np.flatnonzero(~np.isnan(matrix.diagonal()))
        inside = np.ix_(known, known)
        inverse = np.zeros((size, size))
        inverse[inside] = np.linalg.pinv(matrix[inside] + np.eye(len(known)) * 1e-6)
        return pd.DataFrame({"query_id": group["query_id"], "inverse": [inverse.tolist()]})

    return run


def raw_distances(scaled: DataFrame) -> DataFrame:
    """(query_id, row, raw_distance), Euclidean, from long scaled rows with normalised weights."""
    difference = F.col("z") - F.col("target_z")
    return scaled.groupBy("query_id", "row").agg(
        F.sqrt(F.sum(difference * difference * F.col("weight"))).alias("raw_distance")
    )


def pair_distances(scaled: DataFrame, metric: str, names: Sequence[str] = tuple(FEATURE_WEIGHTS)) -> DataFrame:
    """Adds raw_distance to rows of ``scaled_pairs``, which are read twice for
    the covariance: its matrix is one aggregate over the rows, and its quadratic
    form an expression over a row's arrays."""
    size = len(names)

    def total(terms: list[Column]) -> Column:
        return sum(terms[1:], terms[0])

    difference = [F.col("_z")[i] - F.col("_target_z")[i] for i in range(size)]
    euclid = F.sqrt(
        total([F.coalesce(d * d * F.col("_weights")[i], F.lit(0.0)) for i, d in enumerate(difference)])
    )
    if metric != "mahalanobis":
        return scaled.withColumn("raw_distance", euclid)
    root = [F.sqrt(F.col("_weights")[i]) for i in range(size)]
    inverse = (
        scaled.select("query_id", *[(F.col("_z")[i] * root[i]).alias(f"u{i}") for i in range(size)])
        .groupBy("query_id")
        .agg(*[F.covar_samp(f"u{i}", f"u{j}").alias(f"c{i}_{j}") for i in range(size) for j in range(i, size)])
        .groupBy("query_id")
        .applyInPandas(_inverse_covariance(size), "query_id long, inverse array<array<double>>")
    )
    quadratic = F.expr("""
        aggregate(zip_with(inverse, _d, (r, x) -> x * aggregate(zip_with(r, _d, (a, b) -> a * b), 0.0D, (s, v) -> s + v)),
            0.0D, (s, v) -> s + v)
    """)
    steps = F.array(*[F.coalesce(d * root[i], F.lit(0.0)) for i, d in enumerate(difference)])
    return (
        scaled.withColumn("_d", steps)
        .join(inverse, "query_id")
        .withColumn(
            "raw_distance",
            F.when(F.col("_pool") > F.col("_used") + 2, F.sqrt(F.greatest(F.lit(0.0), quadratic))).otherwise(euclid),
        )
        .drop("_d", "inverse")
    )


def fixed_families(pool: DataFrame, radius_days: int) -> DataFrame:
    """Family of each window: all history windows whose end lies within half
    the radius, in whole days."""
    half = max(1, math.ceil(radius_days / 2))
    reach = (half + 1) * DAY - 1
    near = (
        Window.partitionBy("query_id").orderBy(F.unix_seconds("window_end")).rangeBetween(-reach, reach)
    )
    return pool.select(
        "*",
        F.min("window_start").over(near).alias("family_start"),
        F.max("window_end").over(near).alias("family_end"),
        F.count(F.lit(1)).over(near).alias("family_window_count"),
    )


def regime_changes(pool: DataFrame, change_threshold: float, max_span_days: int) -> DataFrame:
    """Change score per window and whether a regime must start there for a gap
    or a jump. Gaps in a feature are filled linearly by position."""
    order = Window.partitionBy("query_id").orderBy("window_end")
    behind = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    base = pool.select(
        "query_id", "row", "window_end", F.row_number().over(order).alias("_pos"),
        *[F.col(c).alias(f"v{i}") for i, c in enumerate(REGIME_FEATURES)],
    )
    count = len(REGIME_FEATURES)

    def known(i: int) -> Column:
        return F.when(F.col(f"v{i}").isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(f"v{i}").alias("v")))

    edges = base.select(
        "*",
        *[F.last(known(i), ignorenulls=True).over(behind).alias(f"b{i}") for i in range(count)],
        *[F.first(known(i), ignorenulls=True).over(ahead).alias(f"a{i}") for i in range(count)],
    )

    def filled(i: int) -> Column:
        b, a = F.col(f"b{i}"), F.col(f"a{i}")
        slope = (a["v"] - b["v"]) / F.nullif((a["p"] - b["p"]).cast("double"), F.lit(0.0))
        inside = b["v"] + slope * (F.col("_pos") - b["p"])
        return F.coalesce(F.col(f"v{i}"), inside, a["v"], b["v"], F.lit(0.0))

    dense = edges.select(
        "query_id", "row", "window_end", *[filled(i).alias(f"v{i}") for i in range(count)]
    )
    steps = dense.select(
        "query_id", "row", "window_end",
        F.date_diff("window_end", F.lag("window_end").over(order)).alias("gap_days"),
        *[(F.col(f"v{i}") - F.lag(f"v{i}").over(order)).alias(f"d{i}") for i in range(count)],
    )
    query = Window.partitionBy("query_id")
    around = steps.select(
        "*",
        *[F.expr(f"percentile(d{i}, 0.5)").over(query).alias(f"c{i}") for i in range(count)],
        *[F.stddev_pop(f"d{i}").over(query).alias(f"s{i}") for i in range(count)],
    )
    spread = around.select(
        "*", *[F.expr(f"percentile(abs(d{i} - c{i}), 0.5)").over(query).alias(f"m{i}") for i in range(count)]
    )

    def score(i: int) -> Column:
        scale = F.when(F.col(f"m{i}") > 1e-9, F.col(f"m{i}") * 1.4826).otherwise(F.col(f"s{i}"))
        scale = F.when(scale > 1e-9, scale).otherwise(F.lit(1.0))
        return F.abs((F.col(f"d{i}") - F.col(f"c{i}")) / scale)

    change = F.greatest(*[score(i) for i in range(count)])
    gap = max(31, max_span_days // 3)
    return spread.select(
        "query_id", "row", "window_end", "gap_days", change.alias("change_score"),
        F.coalesce((F.col("gap_days") > gap) | (change >= change_threshold), F.lit(True)).alias("starts"),
    )


def _number_regimes(max_span_days: int):
    """Sequential part of the segmentation: a regime also ends once it spans
    too long, and the span restarts at each new regime."""

    def number(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("day")
        days, starts = group["day"].to_numpy(), group["starts"].to_numpy()
        regime, begun, out = -1, 0, np.empty(len(group), dtype="int64")
        for i in range(len(group)):
            if starts[i] or days[i] - begun > max_span_days:
                regime, begun = regime + 1, days[i]
            out[i] = regime
        return group.assign(regime=out)[["query_id", "row", "regime"]]

    return number


def adaptive_families(pool: DataFrame, max_span_days: int, change_threshold: float) -> DataFrame:
    """One representative (the nearest window) per adaptive regime."""
    changes = regime_changes(pool, change_threshold, max_span_days).select(
        "query_id", "row", F.unix_date(F.to_date("window_end")).alias("day"), "starts"
    )
    regimes = changes.groupBy("query_id").applyInPandas(
        _number_regimes(max_span_days), "query_id long, row long, regime long"
    )
    inside = Window.partitionBy("query_id", "regime")
    placed = pool.join(regimes, ["query_id", "row"]).select(
        *pool.columns,
        F.min("window_start").over(inside).alias("family_start"),
        F.max("window_end").over(inside).alias("family_end"),
        F.count(F.lit(1)).over(inside).alias("family_window_count"),
        F.col("regime").alias("adaptive_regime_id"),
        F.lit(0.0).alias("family_change_score"),
        F.row_number().over(inside.orderBy("adjusted_distance", "window_end")).alias("_first"),
    )
    return placed.filter("_first = 1").drop("_first")


def pick_separate_families(candidates: DataFrame, k: int, buffer_days: int) -> DataFrame:
    """Greedy choice by distance of at most k families whose intervals keep the
    buffer apart (touching the buffer counts as overlap)."""
    item = "struct<d:double,e:bigint,row:bigint,s:bigint,f:bigint>"
    sized = candidates.groupBy("query_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("adjusted_distance").alias("d"),
                    F.unix_seconds("window_end").alias("e"),
                    F.col("row"),
                    F.unix_seconds("family_start").alias("s"),
                    F.unix_seconds("family_end").alias("f"),
                )
            )
        ).alias("_ranked")
    )
    buffer = max(0, int(buffer_days)) * DAY

    def step(chosen: Column, new: Column) -> Column:
        clash = F.exists(
            chosen, lambda c: (new["s"] <= c["f"] + buffer) & (new["f"] >= c["s"] - buffer)
        )
        return F.when((F.size(chosen) >= k) | clash, chosen).otherwise(
            F.concat(chosen, F.array(new))
        )

    chosen = sized.select(
        "query_id",
        F.posexplode(F.aggregate("_ranked", F.array().cast(f"array<{item}>"), step)).alias("_i", "_c"),
    ).select("query_id", F.col("_c.row").alias("row"), (F.col("_i") + 1).alias("analogue_rank"))
    return candidates.join(chosen, ["query_id", "row"])


def nearest_states(
    fingerprints: DataFrame,
    queries: DataFrame,
    window_days: int,
    k: int = 5,
    exclusion_days: int = 365,
    diversity_days: int | None = None,
    family_gap_days: int | None = None,
    family_buffer_days: int | None = None,
    metric: str = "euclidean",
    features: Sequence[str] | None = None,
    strict_epoch: bool = True,
    family_method: str = "fixed",
    change_threshold: float = 3.5,
) -> SimilarityResult:
    """Nearest independent families for each query.

    ``queries``: query_id long, tectonic_domain, target_end (NULL = latest).
    ``fingerprints`` must hold one population. A query whose history is too
    short, or that has fewer than two usable features, yields no neighbours;
    ``pools`` says which.
    """
    names = list(features or FEATURE_WEIGHTS)
    gap = family_gap_days if family_gap_days is not None else diversity_days
    gap = int(gap if gap is not None else max(window_days * 8, 365))
    buffer = int(family_buffer_days if family_buffer_days is not None else max(window_days, 90))
    states = fingerprints.filter((F.col("window_days") == window_days) & F.col("window_end").isNotNull())
    names = [n for n in names if n in states.columns]
    targets = staged(targets_asof(states, queries))

    def target(column: str) -> Column:
        return F.col(f"t.target.{column}")

    def value(column: str) -> Column:
        return F.col(f"f.{column}")

    condition = (value("tectonic_domain") == target("tectonic_domain")) & (
        value("window_end") <= target("window_end") - F.expr(f"interval {int(exclusion_days)} days")
    )
    if strict_epoch:
        epoch = F.coalesce(target("comparison_epoch"), F.lit(""))
        condition = condition & ((epoch == "") | (value("comparison_epoch") == epoch))
    # A pair of a target and a window of its history: what distances and families need, no more.
    kept = ["window_start", "window_end", *[c for c in REGIME_FEATURES if family_method == "adaptive"]]
    pairs = targets.alias("t").join(states.alias("f"), condition).select(
        F.col("t.query_id").alias("query_id"),
        F.unix_seconds(value("window_end")).alias("row"),
        *[value(c).alias(c) for c in kept],
        comparability(value, target)["comparability_score"].alias("comparability_score"),
        *[value(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)],
        *[target(n).cast("double").alias(f"t{i}") for i, n in enumerate(names)],
    )
    scaled = staged(scaled_pairs(pairs, names))
    sizes = scaled.groupBy("query_id").agg(
        F.max("_pool").alias("pool_size"), F.max("_used").alias("usable_features")
    )
    too_short, too_few = max(5, k), 2
    pools = (
        targets.select("query_id")
        .join(sizes, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("pool_size", F.lit(0)).alias("pool_size"),
            F.coalesce("usable_features", F.lit(0)).alias("usable_features"),
        )
        .withColumn(
            "status",
            F.when(F.col("pool_size") < too_short, "history_too_short")
            .when(F.col("usable_features") < too_few, "too_few_features")
            .otherwise("ok"),
        )
    )
    ready = scaled.filter((F.col("_pool") >= too_short) & (F.col("_used") >= too_few))
    query = Window.partitionBy("query_id")
    measured = spread_evenly(pair_distances(ready, metric, names), "query_id").withColumn(
        "adjusted_distance", F.col("raw_distance") / clip(F.col("comparability_score"), 0.20, 1.0)
    )
    middle = F.greatest(F.expr("percentile(adjusted_distance, 0.5)").over(query), F.lit(1e-6))
    pool = measured.withColumn("similarity", F.exp(-F.col("adjusted_distance") / middle)).drop("_pool", "_used")
    if family_method == "adaptive":
        families = adaptive_families(staged(pool), gap, change_threshold)
        prefix, label = "REG", "adaptive_regime"
    else:
        families = fixed_families(pool, gap)
        prefix, label = "FAM", "fixed_window"
    chosen = pick_separate_families(staged(families), k, buffer)
    # Only chosen windows bring the other columns of their state.
    own = [c for c in chosen.columns if c not in {"query_id", "row", "comparability_score", *kept}]
    neighbours = staged(
        chosen.alias("c")
        .join(targets.alias("t"), "query_id")
        .join(
            states.alias("f"),
            (value("tectonic_domain") == target("tectonic_domain")) & (value("window_end") == F.col("c.window_end")),
        )
        .select(
            "query_id", "c.row", "f.*",
            *[score.alias(name) for name, score in comparability(value, target).items()],
            *[F.col(f"c.{name}").alias(name) for name in own],
            F.array(*[target(n).cast("double") for n in names]).alias("_target"),
            F.lit(gap).alias("family_radius_days"),
            F.lit(buffer).alias("family_buffer_days"),
            interval_id(prefix, F.col("c.family_start"), F.col("c.family_end")).alias("family_id"),
            episode_id(F.col("c.window_end")).alias("episode_id"),
            F.lit(label).alias("family_method"),
        )
    )
    return SimilarityResult(
        neighbours=neighbours.drop("row", "_z", "_target_z", "_weights", "_target"),
        feature_differences=feature_differences(neighbours, names),
        targets=targets.select("query_id", "target.*"),
        pools=pools,
        family_gap_days=gap,
        family_buffer_days=buffer,
    )


def feature_differences(neighbours: DataFrame, names: Sequence[str]) -> DataFrame:
    """Share of each feature in a neighbour's weighted difference, in percent.

    Takes neighbours with the arrays of ``scaled_pairs`` and ``_target``.
    """
    per = Window.partitionBy("query_id", "row")
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"),
                F.col("_target")[i].alias("target_value"),
                F.col(n).cast("double").alias("neighbour_value"),
                F.abs(F.col("_z")[i] - F.col("_target_z")[i]).alias("robust_absolute_difference"),
                F.col("_weights")[i].alias("_weight"),
            )
            for i, n in enumerate(names)
        ]
    )
    rows = (
        neighbours.select(
            "query_id", "row", "analogue_rank", F.col("window_end").alias("neighbour_window_end"),
            "episode_id", "family_id", F.explode(entries).alias("_e"),
        )
        .select("*", "_e.*")
        .filter("_weight is not null")
        .withColumn("weighted_difference", F.col("robust_absolute_difference") * F.col("_weight"))
        .drop("_e", "_weight")
    )
    total = F.sum("weighted_difference").over(per)
    return rows.withColumn(
        "contribution_pct",
        F.when(total > 0, F.col("weighted_difference") / total * 100.0).otherwise(0.0),
    ).drop("row")


def top_contributions(differences: DataFrame, count: int) -> DataFrame:
    """The largest contributions of each neighbour (a top-k report)."""
    rank = Window.partitionBy("query_id", "analogue_rank").orderBy(
        F.desc("contribution_pct"), "feature"
    )
    return differences.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= count).drop("_r")
