"""Probability scores: calibration, classification, ranking and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeloom.fixed_values import DECISION_THRESHOLDS, MODELS
from quakeloom.functions.scalar import brier_skill_score, clip, wilson_interval
from quakeloom.operators.distributed import running_totals

SCENARIO = ("tectonic_domain", "catalogue_mode", "magnitude_policy", "threshold_magnitude", "horizon_days")


class GrowingIsotonic:
    """Isotonic fit of y on x that takes points one at a time, equal x averaged.

    Only the knots are kept. The fit between two of them is a slope of the
    greatest convex minorant of the cumulative sums: the one that touches the
    points before and the points after. The two touching points are found in
    turns, from the knots outwards, so a question costs a few passes over arrays
    and nothing is fitted again.
    """

    def __init__(self) -> None:
        self.knots = np.empty(0)
        self.weights = np.empty(0)
        self.sums = np.empty(0)

    def add(self, x: float, y: float) -> None:
        at = int(np.searchsorted(self.knots, x))
        if at == len(self.knots) or self.knots[at] != x:
            self.knots = np.insert(self.knots, at, x)
            self.weights = np.insert(self.weights, at, 0.0)
            self.sums = np.insert(self.sums, at, 0.0)
        self.weights[at] += 1.0
        self.sums[at] += y

    def _level(self, width: np.ndarray, height: np.ndarray, knot: int) -> float:
        """The fitted value at a knot, from the cumulative weights and sums."""
        left, right, slope = knot, knot + 1, 0.0
        for _ in range(len(width)):
            ahead = (height[knot + 1 :] - height[left]) / (width[knot + 1 :] - width[left])
            to = knot + 1 + int(np.argmin(ahead))
            behind = (height[to] - height[: knot + 1]) / (width[to] - width[: knot + 1])
            start = int(np.argmax(behind))
            slope = float(behind[start])
            if (start, to) == (left, right):
                break
            left, right = start, to
        return min(1.0, max(0.0, slope))

    def predict(self, x: float) -> float:
        """Between knots on a line, beyond them the value at the last."""
        width = np.concatenate(([0.0], np.cumsum(self.weights)))
        height = np.concatenate(([0.0], np.cumsum(self.sums)))
        after = int(np.searchsorted(self.knots, x))
        if after == len(self.knots):
            return self._level(width, height, after - 1)
        high = self._level(width, height, after)
        if after == 0 or self.knots[after] == x:
            return high
        low = self._level(width, height, after - 1)
        part = (x - self.knots[after - 1]) / (self.knots[after] - self.knots[after - 1])
        return low + (high - low) * part


def _calibrate(minimum_history: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cutoff").reset_index(drop=True)
        p = group["analogue_probability"].to_numpy(float)
        o = group["observed_outcome"].astype(float).to_numpy()
        usable = np.isfinite(p) & np.isfinite(o)
        out = np.full(len(group), np.nan)
        past, count, outcomes = GrowingIsotonic(), 0, set()
        for i in range(len(group)):
            enough = count >= minimum_history and len(outcomes) > 1 and len(past.knots) > 2
            if enough and np.isfinite(p[i]):
                out[i] = past.predict(p[i])
            if usable[i]:
                past.add(p[i], o[i])
                outcomes.add(o[i])
                count += 1
        group["analogue_calibrated_probability"] = out
        return group

    return run


def add_expanding_isotonic_calibration(
    scores: DataFrame, minimum_history: int = 30, keys: Sequence[str] = SCENARIO
) -> DataFrame:
    """Calibrate each cutoff on earlier cutoffs of its scenario only. A
    scenario has one row per cutoff, so its size is bounded by the calendar."""
    keys = [k for k in keys if k in scores.columns]
    base = scores.drop("analogue_calibrated_probability", "brier_analogue_calibrated")
    fields = ", ".join(f"`{n}` {t}" for n, t in base.dtypes)
    if not keys:
        base = base.withColumn("_all", F.lit(0))
        keys, fields = ["_all"], fields + ", _all int"
    done = base.groupBy(*keys).applyInPandas(
        _calibrate(minimum_history), f"{fields}, analogue_calibrated_probability double"
    ).drop("_all")
    p = F.nanvl("analogue_calibrated_probability", F.lit(None).cast("double"))
    error = p - F.col("observed_outcome").cast("double")
    return done.withColumn("analogue_calibrated_probability", p).withColumn(
        "brier_analogue_calibrated", error * error
    )


def model_rows(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per score and model that has a probability: model, p, outcome,
    and the Brier terms of the model and both references on the same row."""
    entries = F.array(
        *[
            F.struct(
                F.lit(label).alias("model"),
                F.col(p).cast("double").alias("p"),
                F.col(b).cast("double").alias("brier"),
            )
            for label, p, b in MODELS
            if p in scores.columns
        ]
    )
    return (
        scores.select(
            *keys,
            F.col("observed_outcome").cast("int").alias("outcome"),
            "brier_historical",
            "brier_poisson",
            F.explode(entries).alias("_m"),
        )
        .select(*keys, "_m.*", "outcome", "brier_historical", "brier_poisson")
        .filter("p is not null and outcome is not null")
    )


def calibration_bin(p: Column, bins: int) -> Column:
    """1-based bin of p in [0, 1] over (a, b] intervals; 0 joins the first.
    Borders are the doubles i * (1 / bins), so the guess is corrected."""
    q = clip(p, 0.0, 1.0)
    guess = F.greatest(F.lit(1), F.ceil(q * bins))
    step = 1.0 / bins
    down = F.when((guess > 1) & (q <= (guess - 1) * F.lit(step)), guess - 1).otherwise(guess)
    up = F.when((down < bins) & (q > down * F.lit(step)), down + 1).otherwise(down)
    return up.cast("int")


def calibration_table(rows: DataFrame, keys: Sequence[str] = ("model",), bins: int = 5) -> DataFrame:
    """Mean probability, observed frequency and Wilson bounds per bin."""
    grouped = (
        rows.withColumn("bin", calibration_bin(F.col("p"), bins))
        .groupBy(*keys, "bin")
        .agg(
            F.avg("p").alias("mean_probability"),
            F.count(F.lit(1)).alias("cutoffs"),
            F.sum("outcome").alias("positives"),
        )
    )
    frequency = F.col("positives") / F.col("cutoffs")
    lower, upper = wilson_interval(frequency, F.col("cutoffs"))
    return grouped.select(
        *keys, "bin", "mean_probability", frequency.alias("observed_frequency"),
        lower.alias("ci_lower"), upper.alias("ci_upper"), "cutoffs", "positives",
    )


def expected_calibration_error(
    rows: DataFrame, keys: Sequence[str] = ("model",), bins: int = 10
) -> DataFrame:
    per_bin = (
        rows.withColumn("bin", calibration_bin(F.col("p"), bins))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.avg("outcome").alias("o"))
    )
    return per_bin.groupBy(*keys).agg(
        (F.sum(F.col("n") * F.abs(F.col("p") - F.col("o"))) / F.sum("n")).alias(
            "expected_calibration_error"
        )
    )


def classification_metrics(
    rows: DataFrame,
    keys: Sequence[str] = ("model",),
    thresholds: Sequence[float] = DECISION_THRESHOLDS,
) -> DataFrame:
    """Confusion counts and rates per decision threshold, in one pass: the
    thresholds are a literal array, counted by conditional sums."""
    counts = []
    for i, t in enumerate(thresholds):
        flagged, positive = F.col("p") >= float(t), F.col("outcome") == 1
        counts += [
            F.count_if(flagged & positive).alias(f"tp{i}"),
            F.count_if(flagged & ~positive).alias(f"fp{i}"),
            F.count_if(~flagged & ~positive).alias(f"tn{i}"),
            F.count_if(~flagged & positive).alias(f"fn{i}"),
        ]
    entries = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("decision_threshold"),
                *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "tn", "fn")],
            )
            for i, t in enumerate(thresholds)
        ]
    )
    flat = rows.groupBy(*keys).agg(*counts).select(*keys, F.explode(entries).alias("_e")).select(
        *keys, "_e.*"
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return flat.select(
        *keys, "decision_threshold",
        tp.alias("true_positives"), fp.alias("false_positives"),
        tn.alias("true_negatives"), fn.alias("false_negatives"),
        precision.alias("precision"), recall.alias("recall"),
        F.when(precision + recall > 0, precision * recall * 2 / (precision + recall)).alias("f1"),
        F.try_divide(fp, fp + tn).alias("false_alarm_rate"),
    )


def precision_recall_points(rows: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Precision and recall at every distinct threshold, from running totals
    over descending thresholds; keys with one class only are left out."""
    steps = rows.groupBy(*keys, "p").agg(
        F.sum("outcome").alias("_tp"), F.count(F.lit(1)).alias("_n")
    )
    totals = steps.groupBy(*keys).agg(F.sum("_tp").alias("positives"), F.sum("_n").alias("cutoffs"))
    totals = totals.filter("positives > 0 and positives < cutoffs")
    running = running_totals(
        steps, keys, [F.desc("p")], {"tp": F.col("_tp"), "flagged": F.col("_n")}
    )
    return running.join(totals, list(keys)).select(
        *keys,
        F.col("p").alias("threshold"),
        (F.col("tp") / F.col("flagged")).alias("precision"),
        (F.col("tp") / F.col("positives")).alias("recall"),
        (F.col("_tp") / F.col("positives")).alias("recall_step"),
        "cutoffs",
        "positives",
    )


def average_precision(points: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.sum(F.col("recall_step") * F.col("precision")).alias("average_precision")
    )


def precision_recall_table(rows: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """The curve with its closing point (recall 0, precision 1)."""
    points = precision_recall_points(rows, keys)
    closing = points.select(*keys, "cutoffs", "positives").distinct().select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"), F.lit(0.0).alias("recall_step"), "cutoffs", "positives",
    )
    return (
        points.unionByName(closing)
        .join(average_precision(points, keys), list(keys))
        .drop("recall_step")
    )


def model_metrics(rows: DataFrame, keys: Sequence[str] = ("model",), bins: int = 5) -> DataFrame:
    """Roll-up per model; reference Brier means use the model's own rows."""
    keys = list(keys)
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("valid_cutoffs"),
        F.avg("p").alias("mean_probability"),
        F.avg("outcome").alias("observed_frequency"),
        F.avg("brier").alias("mean_brier"),
        brier_skill_score(F.avg("brier"), F.avg("brier_historical")).alias("bss_vs_empirical"),
        brier_skill_score(F.avg("brier"), F.avg("brier_poisson")).alias("bss_vs_poisson"),
    )
    return base.join(expected_calibration_error(rows, keys, bins), keys, "left").join(
        average_precision(precision_recall_points(rows, keys), keys), keys, "left"
    )


def calibration_status(
    scores: DataFrame, keys: Sequence[str] = (), minimum_cuts: int = 30, minimum_positives: int = 5
) -> DataFrame:
    valid = F.col("analogue_calibrated_probability").isNotNull() & F.col("observed_outcome").isNotNull()
    counted = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_cutoffs"),
        F.count_if(F.col("observed_outcome").cast("int") == 1).alias("positives"),
        F.count_if(valid).alias("calibrated_cutoffs"),
        F.count_if(valid & (F.col("observed_outcome").cast("int") == 1)).alias("calibrated_positives"),
    )
    cuts, hits = F.col("calibrated_cutoffs"), F.col("calibrated_positives")
    return counted.withColumn(
        "calibration_status",
        F.when(cuts == 0, "unavailable")
        .when((cuts < minimum_cuts) | (hits < minimum_positives), "experimental")
        .otherwise("adequate"),
    )


def summarise_backtest_grid(
    scores: DataFrame, bins: int = 5, minimum_history: int = 30
) -> DataFrame:
    """Model metrics and calibration state per scenario."""
    keys = [k for k in SCENARIO if k in scores.columns]
    if "analogue_calibrated_probability" not in scores.columns:
        scores = add_expanding_isotonic_calibration(scores, minimum_history, keys)
    metrics = model_metrics(model_rows(scores, keys), [*keys, "model"], bins)
    status = calibration_status(scores, keys)
    if not keys:
        return metrics.join(status.withColumn("_j", F.lit(0)).drop("_j"), F.lit(True))
    return metrics.join(status, keys)


def pivot_skill(summary: DataFrame, horizons: Sequence[int], model: str = MODELS[0][0]) -> DataFrame:
    """Mean skill against Poisson, thresholds by horizons."""
    return (
        summary.filter(F.col("model") == model)
        .groupBy("threshold_magnitude")
        .pivot("horizon_days", list(horizons))
        .agg(F.avg("bss_vs_poisson"))
        .orderBy("threshold_magnitude")
    )
