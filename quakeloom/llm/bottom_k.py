"""Bottom-k sketches of word shingles.

A sketch is the ``k`` least of a set's 64-bit shingle hashes. Two sketches
merge into the sketch of the union, so sketches of parts combine in any order.
The least ``k`` of a union are a uniform sample of it, from which resemblance
(Jaccard), containment and the number of different shingles are estimated; a
set of fewer than ``k`` shingles is held whole, and its figures are exact.

As text, a sketch is the Base64 form of its hashes in ascending order, eight
big-endian bytes each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm import words
from quakeloom.llm.arrow import bytes_of, map_arrow, slices
from quakeloom.llm.histogram_shards import NO_KEY, find_splitters, part_of
from quakeloom.llm.tables import documents
from quakeloom.session import ship_package, staged

K = 128
SHINGLE = 5
SLICE_BYTES = 1 << 20
PART_BYTES = 16 << 20


def sketches(texts: pa.Array, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of every text. One of fewer words than ``shingle``, but not
    none, has a single shingle of them all; one without words has none."""
    data, borders = bytes_of(texts)
    starts, ends, word_borders = words.spans(data, borders)
    hashed = words.hashes(data, starts, ends)
    found = words.windows(hashed, shingle)
    out = []
    for low, high in zip(word_borders[:-1].tolist(), word_borders[1:].tolist(), strict=True):
        if high - low >= shingle:
            mine = np.sort(found[low : high - shingle + 1])
            mine = mine[np.diff(mine, prepend=~mine[:1]) != 0] if len(mine) > 1 else mine
        else:
            mine = words.windows(hashed[low:high], high - low) if high > low else hashed[:0]
        out.append(mine[:k].copy())
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    both = np.sort(np.concatenate((a, b)))
    return both[np.concatenate(([True], both[1:] != both[:-1]))][:k] if len(both) else both


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate((a, b)))
    again = both[1:] == both[:-1]
    new = np.concatenate(([True], ~again))
    total = min(k, int(new.sum()))
    if total == k:
        last = int(np.flatnonzero(new)[k - 1])
        again = again[: last + 1]
    return float(again.sum()) / total


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of different shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first set's shingles that the second has too; an empty set is contained."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return float(min(1.0, shared / distinct(a, k)))


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Per row of (doc_id, text): doc_id, fingerprint, n_shingles (estimated).

    A null text is an empty one, with an empty fingerprint.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                found = sketches(piece.column("text"), k, shingle)
                yield pa.record_batch(
                    {
                        "doc_id": piece.column("doc_id"),
                        "fingerprint": [to_text(s) for s in found],
                        "n_shingles": [distinct(s, k) for s in found],
                    }
                )

    return map_arrow(
        docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string, n_shingles double"
    )


def merged(prints: DataFrame, keys: list[str], k: int = K, salts: int = 64) -> DataFrame:
    """The fingerprint of the union of each group's texts, whatever its size.

    Sketches of a group are first merged in ``salts`` parts, in bounded memory.
    """
    ship_package(prints.sparkSession)
    kinds = ", ".join(f"`{c}` {prints.schema[c].dataType.simpleString()}" for c in keys)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.empty(0, np.uint64)
        for batch in batches:
            for text in batch.column("fingerprint").to_pylist():
                total = merge(total, from_text(text or ""), k)
        yield pa.record_batch(
            {**{c: pa.array([v.as_py()], v.type) for c, v in zip(keys, key, strict=False)}, "fingerprint": [to_text(total)], "n_shingles": [distinct(total, k)]}
        )

    schema = f"{kinds}, fingerprint string, n_shingles double"
    salted = prints.withColumn("_salt", F.pmod(F.xxhash64("fingerprint"), F.lit(salts)))
    parts = salted.groupBy(*keys, "_salt").applyInArrow(run, schema)
    return parts.groupBy(*keys).applyInArrow(run, schema)


def with_next(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Parts of (doc_id, text) in descending doc_id order, each ending with the next part's first row.

    Splitters of near-equal bytes are found by exact counts, and the rows move
    once. Columns: part, doc_id, text, ``extra`` (1 for the added row, which is
    the last of its partition; the last part's is the first document). Rows of
    one doc_id follow the hash of their text.
    """
    keyed = docs.select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(NO_KEY)).alias("_first"), F.xxhash64("text").alias("_second")
    )
    keys = staged(
        keyed.select("_first", "_second", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("_size"))
    )
    total = keys.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_bytes))
    splitters, _, _ = find_splitters(keys, "_first", "_second", "_size", parts, tolerance=0.1)
    part = part_of(F.col("_first"), F.col("_second"), splitters)
    # The greatest key of each part: one row a part.
    tops = sorted(
        tuple(r)
        for r in keys.groupBy(part.alias("part")).agg(F.max(F.struct("_first", "_second")).alias("top"))
        .select("part", "top._first", "top._second").collect()
    )
    above = {p: tops[(i + 1) % len(tops)][0] for i, (p, _, _) in enumerate(tops)}
    extras = docs.sparkSession.createDataFrame(
        [(a, b, above[p]) for p, a, b in tops], "_first long, _second long, _to int"
    )
    placed = (
        keyed.withColumn("_own", part)
        .join(F.broadcast(extras), ["_first", "_second"], "left")
        .select("*", F.explode(F.expr(
            "if(_to is null, array(struct(_own as part, 0 as extra)),"
            " array(struct(_own as part, 0 as extra), struct(_to as part, 1 as extra)))"
        )).alias("_at"))
        .select("_at.part", "_at.extra", "_first", "_second", "doc_id", "text")
    )
    return (
        placed.repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", "extra", F.desc("_first"), F.desc("_second"))
        .select("part", "doc_id", "text", "extra")
    )


def edited(text: str, following: str) -> str:
    """The last third of the characters replaced by the start of another text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    over = False
    for batch in batches:
        for piece in slices(batch, "text", SLICE_BYTES):
            if over:
                continue
            flags = piece.column("extra").to_pylist()
            if 1 in flags:  # one added row is enough, should it occur several times
                piece, over = piece.slice(0, flags.index(1) + 1), True
            texts = piece.column("text").fill_null("")
            rows = list(zip(piece.column("doc_id").to_pylist(), texts.to_pylist(), sketches(texts), strict=True))
            if last is not None:
                rows.insert(0, last)
            last = rows[-1]
            changed = [edited(a[1], b[1]) for a, b in zip(rows, rows[1:], strict=False)]
            prints = sketches(pa.array(changed, pa.string()))
            mine = rows[:-1]
            yield pa.record_batch(
                {
                    "doc_id": pa.array([r[0] for r in mine], pa.int64()),
                    "n_chars": pa.array([len(r[1]) for r in mine], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    "fingerprint": pa.array([to_text(r[2]) for r in mine], pa.string()),
                    "edited_fingerprint": pa.array([to_text(s) for s in prints], pa.string()),
                    "near_edited": pa.array([resemblance(r[2], s) for r, s in zip(mine, prints, strict=True)], pa.float64()),
                    "near_next": pa.array([resemblance(r[2], s[2]) for r, s in zip(mine, rows[1:], strict=True)], pa.float64()),
                    "n_shingles": pa.array([distinct(r[2]) for r in mine], pa.float64()),
                    "contained_in_edited": pa.array([containment(r[2], s) for r, s in zip(mine, prints, strict=True)], pa.float64()),
                }
            )


def op6_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness.

    A null text is empty; two empty texts are alike (1), an empty one is like no
    other (0). A null doc_id comes last. A single document is its own next one;
    an empty table gives an empty result.
    """
    return map_arrow(
        with_next(documents(spark, sf_dir)),
        _compare,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double, n_shingles double, contained_in_edited double",
    )
