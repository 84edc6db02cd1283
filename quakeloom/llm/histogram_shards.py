"""Shards of near-equal bytes by histogram sort.

Candidate key boundaries (probes) are counted exactly over all partitions,
with map-side combine, and refined round by round: every splitter's interval
is cut into equal key ranges, the range that holds the splitter's target is
kept, until a boundary is within tolerance of the target. Only counts reach
the driver, at most ``probes`` per round. With the splitters known, all rows
move once.

The key has two 64-bit parts. The query sorts by (hash of the text, doc_id):
equal texts are neighbours, and a boundary falls inside a group of them only
if no boundary beside it is within tolerance. A group that holds a third of
all rows is split by the second part.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeloom.llm.tables import documents
from quakeloom.session import staged

KEY_BITS = 128
HALF = 1 << 63
LONG = 1 << 64
#: Stands for a missing key; sorts first.
NO_KEY = -HALF


@dataclass(frozen=True)
class Splitter:
    """``key``: smallest 128-bit key to its right; exact bytes and rows to its left."""

    key: int
    size: int
    rows: int


def _unsigned(signed: int) -> int:
    return signed % LONG


def _signed(unsigned: int) -> int:
    return unsigned - LONG if unsigned >= HALF else unsigned


def _prefix(first: Column, second: Column, depth: int) -> list[Column]:
    """The ``depth`` highest bits of the key; one column, or two beyond 64 bits."""
    flip = F.lit(-HALF)
    high, low = first.bitwiseXOR(flip), second.bitwiseXOR(flip)
    if depth <= 64:
        return [F.shiftrightunsigned(high, 64 - depth) if depth < 64 else high]
    return [high, F.shiftrightunsigned(low, 128 - depth) if depth < 128 else low]


def _within(columns: list[Column], depth: int, open_prefixes: list[int]) -> Column:
    """Is the row in one of the open intervals? A literal hash set, one entry a splitter."""
    if depth <= 64:
        return columns[0].isin([_signed(p) for p in open_prefixes])
    # By high part, so that no pair (high of one, low of another) gets in.
    by_high = defaultdict(list)
    for p in open_prefixes:
        by_high[p >> (depth - 64)].append(p & ((1 << (depth - 64)) - 1))
    found = F.lit(False)
    for high, lows in by_high.items():
        found = found | (
            (columns[0] == _signed(high)) & columns[1].isin([_signed(x) for x in lows])
        )
    return found


def find_splitters(
    keys: DataFrame,
    first: str,
    second: str,
    size: str,
    parts: int,
    tolerance: float = 0.005,
    probes: int = 1 << 16,
) -> tuple[list[Splitter], int, int]:
    """``parts`` - 1 splitters of near-equal size; also total size and rows.

    ``tolerance`` is a share of one part. Where no key boundary is that close
    (a very long row, or rows that repeat the whole key), the closest is taken.
    """
    total, rows = keys.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    slack = tolerance * total / parts
    targets = [total * i / parts for i in range(1, parts)]
    found: dict[int, Splitter] = {}
    depth = 0
    # Interval prefix -> (bytes below, rows below, targets inside).
    intervals = {0: (0, 0, list(range(parts - 1)))} if total else {}
    while intervals:
        step = max(1, min(12, (probes // len(intervals)).bit_length() - 1))
        deeper = min(KEY_BITS, depth + step)
        if depth < 64 < deeper:
            deeper = 64
        now, then = _prefix(F.col(first), F.col(second), depth), _prefix(F.col(first), F.col(second), deeper)
        inside = keys if depth == 0 else keys.filter(_within(now, depth, list(intervals)))
        names = [f"_p{i}" for i in range(len(then))]
        counted = (
            inside.select(*[c.alias(n) for c, n in zip(then, names, strict=True)], size)
            .groupBy(*names)
            .agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("rows"))
            .collect()
        )
        below: dict[int, list] = {p: [] for p in intervals}
        for r in counted:
            prefix = _unsigned(r[0]) if deeper <= 64 else (_unsigned(r[0]) << (deeper - 64)) | _unsigned(r[1])
            below[prefix >> (deeper - depth)].append((prefix, r["size"], r["rows"]))
        following = {}
        for parent, (bytes_below, rows_below, wanted) in intervals.items():
            cells = sorted(below[parent])
            sizes = list(accumulate((c[1] for c in cells), initial=bytes_below))
            counts = list(accumulate((c[2] for c in cells), initial=rows_below))
            # Boundary i is to the left of cell i; the last one to the right of all.
            edges = [c[0] for c in cells] + [((parent + 1) << (deeper - depth))]
            for t in wanted:
                at = bisect_left(sizes, targets[t])
                near = min((i for i in (at - 1, at) if 0 <= i < len(sizes)), key=lambda i: abs(sizes[i] - targets[t]))
                if abs(sizes[near] - targets[t]) <= slack or deeper == KEY_BITS:
                    found[t] = Splitter(edges[near] << (KEY_BITS - deeper), sizes[near], counts[near])
                else:
                    cell = at - 1
                    entry = following.setdefault(cells[cell][0], (sizes[cell], counts[cell], []))
                    entry[2].append(t)
        intervals, depth = following, deeper
    end = Splitter(1 << KEY_BITS, total, rows)
    return [found.get(t, end) for t in range(parts - 1)], total, rows


def part_of(first: Column, second: Column, splitters: list[Splitter]) -> Column:
    """How many splitters are not above the key: a balanced tree of comparisons."""

    def reached(splitter: Splitter) -> Column:
        if splitter.key >= 1 << KEY_BITS:
            return F.lit(False)
        high = _signed((splitter.key >> 64) ^ HALF)
        low = _signed((splitter.key & (LONG - 1)) ^ HALF)
        if low == -HALF:
            return first >= high
        return (first > high) | ((first == high) & (second >= low))

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(reached(splitters[middle]), tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(splitters))


def shard_by_bytes(
    rows: DataFrame,
    first: str,
    second: str,
    size: str,
    shards: int = 40,
    tolerance: float = 0.005,
    part_bytes: int = 1 << 30,
    probes: int = 1 << 16,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``shard`` (int, 0 to ``shards`` - 1) and ``slot`` (long, gapless from 0).

    ``first`` and ``second`` name long columns without nulls, the sort key;
    ``ties`` order rows that repeat it, which stay together. ``rows`` is read
    once per round, so stage it when its columns are costly. A shard of more
    than ``part_bytes`` is sorted in several tasks; slots go on over them, as
    the counts below each splitter are exact. Rows of size 0, or none at all,
    are no special case.
    """
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    each = max(1, -(-total // (shards * part_bytes)))
    parts = shards * each
    splitters, _, _ = find_splitters(rows, first, second, size, parts, tolerance, probes)
    starts = [0] + [s.rows for s in splitters]
    offsets = [starts[p] - starts[p - p % each] for p in range(parts)]
    placed = rows.withColumn("_part", part_of(F.col(first), F.col(second), splitters)).repartitionById(
        parts, F.col("_part")
    )
    order = Window.partitionBy("_part").orderBy(first, second, *ties)
    local = F.row_number().over(order).cast("long") - 1
    if each > 1:
        local = local + F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("_part") + 1)
    return placed.select(
        *rows.columns,
        (F.col("_part") / F.lit(each)).cast("int").alias("shard"),
        local.alias("slot"),
    )


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes; see the module.

    Null texts count as size 16 and crc32 0 and form a group like equal texts;
    a null doc_id sorts first; repeated rows keep together with slots of their
    own; an empty table gives an empty result.
    """
    keyed = documents(spark, sf_dir).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.xxhash64("text").alias("_first"),
        F.coalesce("doc_id", F.lit(NO_KEY)).alias("_second"),
    )
    sharded = shard_by_bytes(staged(keyed), "_first", "_second", "size", ties=("size", "text_crc32"))
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
