"""Toxicity: a linear classifier on character n-grams scaled by log-count ratios.

A text's features are the different character n-grams of its lower-cased form,
hashed into a fixed space. Naive Bayes gives each feature the log ratio of its
smoothed shares among toxic and other texts (r). A logistic regression with an
L2 penalty then learns weights for the features scaled by r, and its weights
are blended with their mean size, so that a feature seen seldom still counts.

Only the fit sees labels: a bounded sample of labelled documents (``per_class``
of each class, those with the least hash of the id), in one task. The model is
one vector of fixed size. Scoring is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm.arrow import map_arrow, slices
from quakeloom.llm.tables import documents, table

SPACE_BITS = 19
ORDERS = (3, 4, 5, 6)
SLICE_BYTES = 1 << 19
#: Documents of each class that the fit may see.
PER_CLASS = 2500
#: Share of the learnt weights in the blend with their mean size.
BLEND = 0.75
PENALTY = 0.1
STEPS = 80
#: Parts of the sample for calibration.
FOLDS = 3


@dataclass(frozen=True)
class Model:
    bias: float
    weights: np.ndarray


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, features): the different features of every text, ordered by row;
    only those that are ``wanted`` (a flag for each), if given."""
    lowered = pc.utf8_lower(texts.fill_null("").cast(pa.large_string()))
    borders = np.concatenate(([0], np.cumsum(pc.utf8_length(lowered).to_numpy(zero_copy_only=False))))
    points = np.frombuffer("".join(lowered.to_pylist()).encode("utf-32-le"), np.uint32)
    rows = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(borders))
    left = np.repeat(borders[1:], np.diff(borders)) - np.arange(len(points))  # characters to the text's end
    found = []
    for order in ORDERS:
        count = max(0, len(points) - order + 1)
        code = np.full(count, order, np.uint32)
        for i in range(order):
            code = code * np.uint32(0x01000193) ^ points[i : i + count]
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        code >>= np.uint32(32 - SPACE_BITS)
        inside = left[:count] >= order
        if wanted is not None:
            inside &= wanted[code]
        found.append((rows[:count][inside] << np.uint64(32)) | code[inside])
    keys = np.sort(np.concatenate(found))
    keys = keys[np.diff(keys, prepend=np.uint64(1 << 63)) != 0]
    return (keys >> np.uint64(32)).astype(np.int32), (keys & np.uint64(0xFFFFFFFF)).astype(np.int32)


def _ratios(counts: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio of every feature from its documents of either class, and
    whether it is useful: one of few documents, or which both classes share evenly, tells nothing."""
    smooth = (counts + 1.0) / (np.array([[(labels == 0).sum()], [(labels == 1).sum()]]) + 2.0)
    ratio = np.log(smooth[1] / smooth[0])
    return ratio, (counts.sum(axis=0) >= 3) & (np.abs(ratio) >= 0.4)


def _weights(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The blended weights of all features, times their log-count ratios."""
    size, count = 1 << SPACE_BITS, len(labels)
    toxic = labels[rows] == 1
    counts = np.stack([np.bincount(columns[~toxic], minlength=size), np.bincount(columns[toxic], minlength=size)])
    ratio, useful = _ratios(counts, labels)
    kept = useful[columns]
    rows, columns = rows[kept], columns[kept]
    place = np.cumsum(useful) - 1
    columns, ratio_used = place[columns], ratio[useful]
    values = ratio_used.astype(np.float32)[columns]
    ends = np.searchsorted(rows, np.arange(count + 1))
    norm = np.sqrt(np.maximum(np.bincount(rows, values**2, count), 1e-9)).mean()
    values /= np.float32(norm)
    weights, bias = np.zeros(len(ratio_used)), float(np.log(labels.mean() / (1 - labels.mean())))
    first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for step in range(1, STEPS + 1):
        total = np.concatenate(([0.0], np.cumsum(values * weights[columns])))
        margin = total[ends[1:]] - total[ends[:-1]] + bias
        error = _chance(margin) - labels
        slope = np.append(
            np.bincount(columns, values * error[rows], len(weights)) / count + PENALTY / count * weights, error.mean()
        )
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    full = np.zeros(size)
    full[useful] = (BLEND * weights + (1 - BLEND) * np.abs(weights).mean()) * ratio_used / norm
    return full


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def _calibrated(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make chances of margins, by Newton's method."""
    scale = max(float(np.abs(margin).mean()), 1e-9)
    x = np.stack([margin / scale, np.ones(len(margin))], axis=1)
    found = np.zeros(2)
    for _ in range(50):
        chance = _chance(x @ found)
        slope = x.T @ (chance - labels) + 1e-3 * found
        curve = (x * (chance * (1 - chance))[:, None]).T @ x + 1e-3 * np.eye(2)
        found = found - np.linalg.solve(curve, slope)
    return max(float(found[0]), 1e-3) / scale, float(found[1])


def fit(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray) -> Model:
    """Weights from all documents, on the scale of chances that FOLDS models
    give to documents which they have not seen."""
    count = len(labels)
    fold = np.arange(count) % FOLDS
    both = count > 0 and all(len(np.unique(labels[fold != k])) == 2 for k in range(FOLDS))
    if not both:
        share = (labels.sum() + 0.01) / (count + 1)
        return Model(float(np.log(share / (1 - share))), np.zeros(1 << SPACE_BITS, np.float32))
    margin = np.zeros(count)
    for k in range(FOLDS):
        seen = fold != k
        number = np.cumsum(seen) - 1
        mine = seen[rows]
        weights = _weights(number[rows[mine]], columns[mine], labels[seen])
        margin += np.where(seen, 0.0, np.bincount(rows, weights[columns], count))
    slope, offset = _calibrated(margin, labels)
    return Model(offset, (slope * _weights(rows, columns, labels)).astype(np.float32))


def score(texts: pa.Array, model: Model) -> np.ndarray:
    rows, columns = features(texts, model.weights != 0)
    margin = np.bincount(rows, model.weights[columns], len(texts)) + model.bias
    return _chance(margin)


def fit_texts(texts: pa.Array, labels: np.ndarray) -> Model:
    """Two passes, so that only useful features are held."""
    pieces, counts, start = [], np.zeros((2, 1 << SPACE_BITS), np.int64), 0
    for piece in slices(pa.record_batch({"text": texts}), "text", SLICE_BYTES):
        pieces.append((start, piece.column("text")))
        rows, columns = features(piece.column("text"))
        toxic = labels[start + rows] == 1
        for k, mine in enumerate((columns[~toxic], columns[toxic])):
            counts[k] += np.bincount(mine, minlength=1 << SPACE_BITS)
        start += piece.num_rows
    _, useful = _ratios(counts, labels)
    found = [(np.int32(first) + r, c) for first, (r, c) in ((first, features(t, useful)) for first, t in pieces)]
    empty = np.empty(0, np.int32)
    return fit(np.concatenate([empty, *[f[0] for f in found]]), np.concatenate([empty, *[f[1] for f in found]]), labels)


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sample = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("label", pa.float64())])).combine_chunks()
    texts = sample.column("text").cast(pa.large_string()).combine_chunks()
    model = fit_texts(texts, sample.column("label").to_numpy())
    yield pa.record_batch({"bias": [model.bias], "weights": [model.weights.astype("<f4").tobytes()]})


def in_training(doc_id: Column) -> Column:
    """Rows whose label may be learnt; the others are held out."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class.

    ``labels`` has (doc_id, label 0 or 1); of several labels of a document the
    largest counts, and null ones do not. Where the bound cuts the classes
    unequally, the bias is moved back to their shares among all labels.
    """
    known = labels.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.filter("label = 1").orderBy(*order).limit(per_class).union(
        known.filter("label = 0").orderBy(*order).limit(per_class)
    )
    # At most 2 * per_class rows, so the documents need no shuffle. Their order decides the
    # folds and the order of sums, so it is made by what the rows hold.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(
        "text", F.col("label").cast("double").alias("label"), F.xxhash64("doc_id", "text").alias("_hash"), "doc_id"
    )
    ordered = rows.repartition(1).sortWithinPartitions("_hash", "doc_id", "text").select("text", "label")
    fitted = map_arrow(ordered, _fit_task, "bias double, weights binary").first()
    if fitted is None:
        none = np.empty(0, np.int64)
        return fit(none, none, none)
    # Two rows.
    counts = {r["label"]: r["n"] for r in known.groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = (max(1.0, counts.get(k, 0) / per_class) for k in (0, 1))
    return Model(fitted["bias"] + float(np.log(toxic / clean)), np.frombuffer(fitted["weights"], "<f4"))


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1), in place of a column of that name. A null text scores like an empty one."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                scores = pa.array(score(piece.column("text"), shared.value))
                yield pa.RecordBatch.from_arrays([*piece.columns, scores], [*names, "score"])

    schema = docs.schema.simpleString()[len("struct<") : -1]
    return map_arrow(docs, run, f"{schema},score:double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows that score under ``threshold``; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                yield piece.filter(pa.array(score(piece.column("text"), shared.value) < threshold))

    return map_arrow(docs, run, docs.schema)


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learnt."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long"), F.col("toxic").alias("label"))
    return labels.filter(in_training(F.col("doc_id")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document.

    Rows that share a doc_id are scored one by one; if one is labelled, each
    may be learnt. A null doc_id is not held out (its remainder is unknown).
    Without labels of both classes all scores are the labels' smoothed mean.
    """
    docs = documents(spark, sf_dir)
    model = train(docs, toxic_labels(spark, sf_dir))
    # The scan needs the score only, so the text stays in Python.
    scored = with_score(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
