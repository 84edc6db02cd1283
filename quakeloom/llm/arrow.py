"""Small helpers for functions that get Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from quakeloom.session import ship_package


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT, SMALLER = "67108864b", "8388608b"


def map_arrow(frame: DataFrame, function, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose workers can import this package.

    Unless the session says otherwise, a batch has at most 8 MB in place of
    64: texts are large, and a batch exists in the executor and its worker.
    """
    spark = frame.sparkSession
    ship_package(spark)
    if spark.conf.get(BATCH_BYTES, DEFAULT) == DEFAULT:
        spark.conf.set(BATCH_BYTES, SMALLER)
    return frame.mapInArrow(function, schema)


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of ``column`` each, one row at least."""
    sizes = batch.column(column).cast(pa.large_binary())
    lengths = np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1])
    part = np.cumsum(lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        if high > low:
            yield batch.slice(low, high - low)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: none) and the borders between them."""
    filled = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
