"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``block_bytes``. With q of every Q slots due
to a source (its weight is q / Q), its block j may not start before slot
floor(j Q / q) and must be over by ceil((j + 1) Q / q). Giving each slot to the
released block with the earliest deadline meets all deadlines, since the
weights sum to one; so after any number of slots a source is less than one
block away from its share.

Q is so large that q / Q is the weight to one part in ``FINE``: over a mix of a
thousand million slots the rounding adds less than a thousandth of a block.
Such a schedule does not repeat within a mix, so every block of the mix is dealt
its slot, in integers, on the driver: two numbers a block of 64 KB, half a
million blocks for 30 GB. A block's number comes from running totals per source
that are exact for a source of any size: a hot source is spread over many tasks.
"""

from __future__ import annotations

from array import array
from collections.abc import Mapping
from fractions import Fraction
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm.tables import literal_table, table
from quakeloom.operators.distributed import running_totals
from quakeloom.session import staged

BLOCK_BYTES = 64 << 10
#: Parts of the whole that weights are counted in.
FINE = 1 << 50
PERIOD = 1000
TEMPER = 0.7


def source_key(name: str = "source") -> Column:
    """A missing source is a source of its own."""
    return F.when(F.col(name).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(name).cast("string")))


def shares(sizes: DataFrame, weights: Mapping[str | None, float] | None, period: int) -> DataFrame:
    """Slots of a period per source (_source, total, q), one at least.

    The period has ``FINE`` slots, or ``period`` if that is more. Without ``weights`` a source weighs its bytes to the power ``TEMPER``. With
    them, sources that they do not name, or give nothing, are left out.
    """
    if weights is None:
        weighed = sizes.withColumn("_w", F.pow(F.col("total").cast("double"), F.lit(TEMPER)))
    else:
        named = [("-" if k is None else f"+{k}", float(v)) for k, v in weights.items() if v > 0]
        weighed = sizes.join(F.broadcast(literal_table(sizes.sparkSession, ("_source", "_w"), named)), "_source")
    # One row; the sources that exist share the whole between them.
    whole = weighed.agg(F.sum("_w").alias("_all"))
    return weighed.crossJoin(F.broadcast(whole)).select(
        "_source", "total", F.greatest(F.lit(1), F.round(F.col("_w") / F.col("_all") * max(period, FINE))).cast("long").alias("q")
    )


def schedule(shared: DataFrame, block_bytes: int | None = None, repeat: bool = False) -> DataFrame:
    """The slots of all blocks: _source, turn (the source's block), turn_slot.

    Of sources (_source, total, q), each has the blocks of its ``total`` bytes;
    with ``repeat``, as many as the mix has room for until every source has been
    read once. Without ``block_bytes`` it is one period, q blocks a source. A
    slot that no block is ready for stays empty.
    """
    sources = sorted((r["_source"], r["q"], r["total"]) for r in shared.select("_source", "q", "total").collect())
    period = sum(q for _, q, _ in sources)
    rooms = [q if block_bytes is None else -(-total // block_bytes) for _, q, total in sources]
    if repeat and sources:
        rounds = max(Fraction(n, q) for n, (_, q, _) in zip(rooms, sources, strict=True))
        rooms = [-(-rounds.numerator * q // rounds.denominator) for _, q, _ in sources]
    # Per source: blocks dealt so far. Blocks wait for their release, then for the earliest deadline.
    done, waiting, ready = [0] * len(sources), [(0, i) for i, n in enumerate(rooms) if n], []
    heapify(waiting)
    of, turns, slots, now = array("i"), array("q"), array("q"), 0
    while waiting or ready:
        if not ready:
            now = max(now, waiting[0][0])
        while waiting and waiting[0][0] <= now:
            i = heappop(waiting)[1]
            heappush(ready, (-(-(done[i] + 1) * period // sources[i][1]), i))
        i = heappop(ready)[1]
        of.append(i)
        turns.append(done[i])
        slots.append(now)
        done[i] += 1
        now += 1
        if done[i] < rooms[i]:
            heappush(waiting, (done[i] * period // sources[i][1], i))
    names = pa.DictionaryArray.from_arrays(pa.array(np.frombuffer(of, np.int32)), pa.array([x for x, _, _ in sources], pa.string()))
    dealt = pa.table({"_source": names.cast(pa.string()), "turn": np.frombuffer(turns, np.int64), "turn_slot": np.frombuffer(slots, np.int64)})
    return shared.sparkSession.createDataFrame(dealt)


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    repeat: bool = False,
    block_bytes: int = BLOCK_BYTES,
    period: int = PERIOD,
    seed: int = 0,
) -> DataFrame:
    """Slots of (doc_id, source, size, _text): adds block, epoch, slot and ``offset``.

    The mix is read by (slot, offset). A document lies in the block where it
    begins; a longer one leaves the next slots of its source empty. Inside a
    source, documents follow a hash of their id and ``seed``. Each document
    comes once, and after a source has run out the others keep their order; or,
    with ``repeat``, sources that run out start over (next epoch) until the
    last one has been read once, so that the weights hold to the end.
    """
    sized = docs.withColumn("_source", source_key()).withColumn("_order", F.xxhash64(F.lit(seed), F.col("doc_id")))
    placed = running_totals(
        sized, ["_source"], [F.col("_order"), F.col("doc_id"), F.col("_text"), F.col("size")], {"_upto": F.col("size")}
    )
    # Kept for their several uses: one row a source, and one row a block of the mix.
    sizes = staged(sized.groupBy("_source").agg(F.sum("size").alias("total")))
    slots = staged(schedule(shares(sizes, weights, period), block_bytes, repeat))
    rooms = slots.groupBy("_source").agg(F.count(F.lit(1)).alias("room")).join(sizes, "_source").select(
        "_source", "room", F.ceil(F.col("total") / block_bytes).alias("blocks")
    )
    numbered = placed.withColumn("offset", F.col("_upto") - F.col("size")).withColumn(
        "block", F.floor(F.col("offset") / block_bytes)
    ).join(F.broadcast(rooms), "_source")  # one row a source
    if repeat:
        numbered = numbered.withColumn("epoch", F.explode(F.expr("sequence(0L, (room - 1) div blocks)"))).withColumn(
            "block", F.col("block") + F.col("epoch") * F.col("blocks")
        ).filter("block < room")
    else:
        numbered = numbered.withColumn("epoch", F.lit(0).cast("long"))
    turns = slots.select("_source", F.col("turn").alias("block"), F.col("turn_slot").alias("slot"))
    return numbered.join(turns, ["_source", "block"]).select(*docs.columns, "block", F.col("epoch").cast("int").alias("epoch"), "slot", "offset")


def sized(docs: DataFrame) -> DataFrame:
    """What the mix needs of the documents: no text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.xxhash64("text").alias("_text"),
    )


def mixed_documents(docs: DataFrame, weights: Mapping[str | None, float] | None = None, **options) -> DataFrame:
    """All documents, once each and with all columns, in the order of the mix.

    The result is range-partitioned and sorted by slot, so files written from
    it hold the mix: part by part, row by row. Repeated rows stay together.
    """
    first = mix(sized(docs), weights, **options).groupBy("doc_id", "_text").agg(
        F.min(F.struct("slot", "offset")).alias("_at")
    )
    right = first.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"), "_at.slot", "_at.offset")
    left = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_left"), F.xxhash64("text").alias("_left_hash"))
    on = F.col("_left").eqNullSafe(F.col("_id")) & (F.col("_left_hash") == F.col("_hash"))
    joined = left.join(right, on).select("_row", "slot", "offset")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return joined.repartitionByRange(parts, "slot", "offset").sortWithinPartitions("slot", "offset").select("_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document comes in a mix by tempered weights, small sources repeated.

    A null source is a source; a null or empty text takes one byte; rows that
    repeat are placed one by one; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    return mix(sized(docs), repeat=True).select("doc_id", "source", "size", "block", "epoch", "slot", "offset")
