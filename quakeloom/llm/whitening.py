"""Whitening of embeddings by spectral projection (contour integration).

The covariance is counted exactly: vectors are quantised to integers, centred at
the integers next to their means, and sums of products are kept as integers, so
neither the order of rows nor the number of tasks changes a bit of the result.
Only sums, d x d for vectors of d entries, reach the driver.

Its leading eigenvectors are found there by contour integration. Signs of the
pivots of V - s I (inertia) count the eigenvalues above s and so fix an interval
that holds the wanted ones. A quadrature of complex shifted solves along a
circle around that interval projects a block of vectors onto its eigenspace;
Rayleigh-Ritz extracts the pairs; this repeats until their residuals are at
rounding level. The count from inertia must equal the number of pairs found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm.arrow import map_arrow
from quakeloom.llm.tables import table
from quakeloom.session import staged

SCALE = 256
COMPONENTS = 4
#: Points of the quadrature on the upper half of the circle.
POINTS = 12
ROUNDS = 60
#: Sums are carried as three digits of this base, which Spark adds up as decimals.
DIGIT = 10**18
#: Integers that a double holds exactly.
EXACT = 1 << 53
SAFE = 1 << 62


# -- eigenpairs of a symmetric matrix, by intervals --------------------------------------------


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``: positive pivots of V - shift I, by elimination with
    symmetric pivoting (1 x 1 and 2 x 2 pivots, so no pivot is near zero without need)."""
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        off = np.abs(a - np.diag(np.diag(a)))
        i = int(diagonal.argmax())
        if diagonal[i] >= 0.64 * off.max(initial=0.0):
            order = [i]
        else:
            order = sorted(int(x) for x in np.unravel_index(off.argmax(), off.shape))
        rest = [k for k in range(len(a)) if k not in order]
        pivot, side = a[np.ix_(order, order)], a[np.ix_(rest, order)]
        if len(order) == 1:
            positive += pivot[0, 0] > 0
            update = np.outer(side[:, 0], side[:, 0]) / pivot[0, 0] if pivot[0, 0] else 0.0
        else:
            positive += 1  # a 2 x 2 pivot has one eigenvalue of each sign
            update = side @ np.linalg.solve(pivot, side.T)
        a = a[np.ix_(rest, rest)] - update
    return int(positive)


def interval_of(matrix: np.ndarray, wanted: int) -> tuple[float, float, int]:
    """(low, high, count): the ``wanted`` largest eigenvalues lie above low, ``count`` in all.

    low stands in the middle of the gap below them. Where eigenvalue ``wanted``
    and the next agree to rounding, all that agree are taken in.
    """
    high = float(np.abs(matrix).sum(axis=1).max()) * 1.01 + np.finfo(float).tiny
    floor = -high

    def place(number: int) -> float:
        """Eigenvalue ``number`` (from 1, falling), to rounding."""
        below, above = floor, high
        for _ in range(70):
            middle = (below + above) / 2
            below, above = (middle, above) if count_above(matrix, middle) >= number else (below, middle)
        return (below + above) / 2

    number = wanted
    last = place(number)
    while number < len(matrix):
        following = place(number + 1)
        if last - following > 1e-11 * high:
            return (last + following) / 2, high, number
        number, last = number + 1, following
    return floor, high, len(matrix)


def leading_pairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors as columns."""
    size = len(matrix)
    wanted = min(wanted, size)
    scale = float(np.abs(matrix).max(initial=0.0))
    if not wanted or not scale:
        return np.zeros(wanted), np.eye(size)[:, :wanted]
    v = matrix / scale
    low, high, count = interval_of(v, wanted)
    width = min(size, max(2 * count, count + 8))
    while True:
        values, vectors = _project(v, low, high, width, count)
        if (values > low).sum() == count:
            break
        if width == size:
            raise ArithmeticError(f"{count} eigenvalues are above {low}, {(values > low).sum()} were found")
        width = min(size, 2 * width)
    return values[:wanted] * scale, vectors[:, :wanted]


def _project(v: np.ndarray, low: float, high: float, width: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turns = np.exp(0.5j * np.pi * (nodes + 1))
    block = np.random.default_rng(11).standard_normal((len(v), width))
    best = None
    for _ in range(ROUNDS):
        projected = np.zeros_like(block)
        for turn, weight in zip(turns, weights, strict=True):
            solved = np.linalg.solve((centre + radius * turn) * np.eye(len(v)) - v, block)
            projected += 0.5 * weight * (radius * turn * solved).real
        basis, _ = np.linalg.qr(projected)
        ritz, turned = np.linalg.eigh(basis.T @ v @ basis)
        values, vectors = ritz[::-1], (basis @ turned)[:, ::-1]
        inside = vectors[:, :count]
        error = np.abs(v @ inside - inside * values[:count]).max()
        if best is not None and error >= best[0]:
            break
        best = (error, values, vectors)
        block = vectors
    return best[1], best[2]


# -- exact sums over partitions ------------------------------------------------------------------


def _matrix(batch: pa.RecordBatch, column: str, size: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _largest(values: np.ndarray) -> int:
    return max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0


def _exact_products(y: np.ndarray) -> np.ndarray:
    """y^T y in integers. Doubles hold the sums of a few rows exactly; what is larger is
    multiplied as Python integers."""
    most = _largest(y)
    total = np.zeros((y.shape[1], y.shape[1]), object)
    if most * most >= EXACT:
        y = y.astype(object)
        return y.T @ y
    step = max(1, EXACT // max(1, most * most))
    for at in range(0, len(y), step):
        part = y[at : at + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _digits(values: np.ndarray) -> list[list[int]]:
    """Three digits of base 10^18 of every integer; the first carries the sign."""
    found = []
    for v in values:
        high, low = divmod(int(v), DIGIT)
        high, middle = divmod(high, DIGIT)
        found.append([high, middle, low])
    return found


SUMS = "place int, rows long, high long, middle long, low long"


def _sums(frame: DataFrame, function) -> tuple[int, dict[int, int]]:
    """Rows, and exact totals by place of what ``function`` (x -> integers) makes of the vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, None
        for batch in batches:
            if batch.num_rows:
                size = len(batch.column("x")[0])
                part = function(_matrix(batch, "x", size))
                rows, total = rows + batch.num_rows, part if total is None else total + part
        if total is not None:
            digits = np.array(_digits(total.ravel()), dtype=np.int64).reshape(-1, 3)
            places = np.arange(len(digits), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places), pa.array(np.where(places == 0, rows, 0)), *[pa.array(digits[:, i]) for i in range(3)]],
                ["place", "rows", "high", "middle", "low"],
            )

    summed = (
        map_arrow(frame, partial, SUMS)
        .groupBy("place")
        .agg(F.sum("rows").alias("rows"), *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "middle", "low")])
        .collect()
    )
    values = {r["place"]: (int(r["high"]) * DIGIT + int(r["middle"])) * DIGIT + int(r["low"]) for r in summed}
    return sum(r["rows"] for r in summed), values


# -- the model ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """``sums`` over ``n`` different vectors; ``values`` and ``vectors`` (columns) of their
    covariance, whose trace is ``trace``; ``error``: largest entry of the covariance of
    the whitened vectors minus the identity."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    error: float | None


def quantised(vectors: DataFrame, identifier: str, vector: str, scale: int = SCALE) -> DataFrame:
    """Columns ``vec_id`` and ``x`` = floor(scale * entry), as array<long>.

    Rows whose vector is null or holds null or non-finite entries go. All vectors
    must have as many entries as the most frequent ones (ties: the longer); rows of
    another length, and empty vectors, go as well. Beyond the range of a long, x is
    the end of that range.
    """
    entries = F.col(vector)
    finite = F.forall(entries, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    found = vectors.select(F.col(identifier).alias("vec_id"), entries.alias("_v")).filter(
        entries.isNotNull() & (F.size(entries) > 0) & finite
    )
    lengths = found.groupBy(F.size("_v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).head()
    x: Column = F.transform("_v", lambda c: F.floor(c.cast("double") * scale))
    return found.filter(F.size("_v") == (lengths["size"] if lengths else 0)).select("vec_id", x.alias("x"))


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on each distinct vector of column ``x`` once; None without vectors."""
    unique = staged(x.select("x").distinct())
    n, found = _sums(unique, lambda rows: _column_sums(rows))
    if not n:
        return None
    size = len(found)
    sums = [found[i] for i in range(size)]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=object)

    def products(rows: np.ndarray) -> np.ndarray:
        wide = _largest(rows) + max(map(abs, centre)) >= SAFE
        return _exact_products(rows.astype(object) - centre if wide else rows - centre.astype(np.int64))

    _, found = _sums(unique, products)
    off = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    covariance = np.array(
        [[(n * found[i * size + j] - off[i] * off[j]) / (n * n) for j in range(size)] for i in range(size)]
    )
    values, vectors = leading_pairs(covariance, components)
    trace = float(np.trace(covariance))
    model = Whitening(n, sums, trace, values, vectors, None)
    return Whitening(n, sums, trace, values, vectors, _identity_error(unique, model))


def _column_sums(rows: np.ndarray) -> np.ndarray:
    if _largest(rows) * len(rows) < SAFE:
        return rows.sum(axis=0).astype(object)
    return rows.astype(object).sum(axis=0)


def _deviations(model: Whitening, rows: np.ndarray) -> np.ndarray:
    """n * x - S, in integers."""
    if model.n * _largest(rows) + max(map(abs, model.sums)) < SAFE:
        return model.n * rows - np.array(model.sums, dtype=np.int64)
    return model.n * rows.astype(object) - np.array(model.sums, dtype=object)


def _whitened(model: Whitening, off: np.ndarray) -> np.ndarray:
    """Rows x components; NaN for a component without variance."""
    spread = model.values > 1e-13 * max(model.trace, 0.0)
    weights = np.where(spread, model.vectors / np.sqrt(np.where(spread, model.values, 1.0)), np.nan)
    return (off / model.n).astype(np.float64) @ weights


def _identity_error(unique: DataFrame, model: Whitening) -> float | None:
    """One pass over the fit list: covariance of the whitened vectors against the identity."""
    width = len(model.values)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in batches:
            if batch.num_rows:
                z = _whitened(model, _deviations(model, _matrix(batch, "x", len(model.sums))))
                total += np.vstack([z.sum(axis=0), z.T @ z])
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["place", "total"])

    rows = map_arrow(unique, partial, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((width + 1) * width)
    for r in rows:
        total[r["place"]] = r["total"]
    total = total.reshape(width + 1, width) / model.n
    error = np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(width))
    error = error[~np.isnan(error)]
    return float(error.max()) if error.size else None


OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(x: DataFrame, model: Whitening | None) -> DataFrame:
    """One row for each row of ``x`` (vec_id, x) and component.

    ``deviation`` is null beyond the range of a long. A component without
    variance (fewer different vectors than components, say) has a null
    ``whitened``; ``explained`` is null when nothing varies at all.
    """
    if model is None:
        return x.sparkSession.createDataFrame([], OUTPUT)
    width = len(model.values)
    explained = model.values / model.trace if model.trace > 0 else np.full(width, np.nan)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = _deviations(model, _matrix(batch, "x", len(model.sums)))
            most = _largest(off)
            if most * most * len(model.sums) < SAFE:
                squares = (off * off).sum(axis=1).tolist()
            else:
                squares = [s if (s := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in off]
            z = _whitened(model, off)
            each = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column("vec_id").take(pa.array(np.repeat(np.arange(each), width)))),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), each)),
                    pa.array(np.full(each * width, model.n)),
                    pa.array([s for s in squares for _ in range(width)], pa.int64()),
                    pa.array(z.ravel(), from_pandas=True),
                    pa.array(np.tile(explained, each), from_pandas=True),
                    pa.array([model.error] * (each * width), pa.float64()),
                ],
                [c.split()[0] for c in OUTPUT.split(", ")],
            )

    return map_arrow(x.select(F.col("vec_id").cast("long"), "x"), project, OUTPUT)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the first four components; see ``quantised`` and ``whiten``.

    Rows with a null or repeated vec_id stay rows of their own; equal vectors
    count once in the fit; an empty table gives an empty result.
    """
    x = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return whiten(x, fit(x))
