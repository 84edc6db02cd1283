"""Removal of passages that repeat across documents: seed, extend, keep long ones.

Seeds are winnowed anchors: of the short word runs within each window of
``length`` words, the one with the least hash. Equal windows have equal
anchors, so only windows on an anchor that documents share can repeat; about
one run of words in six is an anchor. Shared seeds are extended both ways by
comparing all windows that lie on them, and neighbouring repeated windows
merge into maximal repeats, all of ``length`` words at least.

Documents lie in buckets of bounded size, and the text moves once: the three
passes over the buckets use one exchange of it.

1. Each bucket sends its different anchors, dealt by hash; an anchor comes
   once from a bucket, however often it occurs there, so no group is hot.
   Those that come from two buckets go back to them.
2. Each bucket sends the windows on such anchors with their first document.
   Windows that start in a smaller document elsewhere go back.
3. Each bucket marks the words of these windows, and of those which a smaller
   document of its own has.

Hashes have 64 bits, and two different windows of one anchor are taken as
equal only if those collide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm import words
from quakeloom.llm.arrow import bytes_of
from quakeloom.llm.tables import documents
from quakeloom.session import ship_package

NO_ID = -(1 << 63)
ANCHOR = 4
BUCKET_BYTES = 2 << 20
#: Buckets' worth of hashes that one group of the dealt ones has.
BUCKETS_A_GROUP = 8


@dataclass
class Bucket:
    ids: np.ndarray
    data: np.ndarray
    borders: np.ndarray
    word_borders: np.ndarray
    places: np.ndarray
    windows: np.ndarray
    anchors: np.ndarray
    owners: np.ndarray


def _bucket(table: pa.Table, length: int) -> Bucket:
    """Words, windows and their anchors of all documents of a bucket."""
    ids = table.column("doc_id").fill_null(NO_ID).to_numpy()
    data, borders = bytes_of(table.column("text").combine_chunks())
    starts, ends, word_borders = words.spans(data, borders)
    hashed = words.hashes(data, starts, ends)
    places = words.window_places(word_borders, length)
    anchor = min(ANCHOR, length)
    if len(places):
        runs = words.windows(hashed, anchor)
        _, least = words.lowest(runs, length - anchor + 1)
        found, seeds = words.windows(hashed, length)[places], runs[least[places]]
    else:
        found = seeds = np.empty(0, np.uint64)
    owners = np.repeat(ids, np.diff(word_borders))[places]
    return Bucket(ids, data, borders, word_borders, places, found, seeds, owners)


def _dealt(bucket: int, groups: int, hashes: np.ndarray, firsts: np.ndarray | None = None) -> pa.Table:
    """One row for each group that gets some of the hashes."""
    target = (hashes % np.uint64(groups)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    target, hashes = target[order], hashes[order]
    begins = np.flatnonzero(np.diff(target, prepend=-1))
    offsets = np.append(begins, len(target)).astype(np.int32)
    columns = {
        "dealt": pa.array(target[begins]),
        "bucket": pa.array(np.full(len(begins), bucket, np.int64)),
        "hashes": pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64))),
    }
    if firsts is not None:
        columns["firsts"] = pa.ListArray.from_arrays(offsets, pa.array(firsts[order]))
    return pa.table(columns)


def _merged(lists: pa.ChunkedArray) -> np.ndarray:
    return np.sort(np.asarray(pc.list_flatten(lists)).view(np.uint64))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _new(ordered: np.ndarray) -> np.ndarray:
    """Is each value other than the one before?"""
    flags = np.ones(len(ordered), bool)
    flags[1:] = ordered[1:] != ordered[:-1]
    return flags


def _first_owner(values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values, the least owner of each, and each row's place among them."""
    order = np.argsort(values)
    ordered = values[order]
    new = _new(ordered)
    begins = np.flatnonzero(new)
    first = np.minimum.reduceat(owners[order], begins) if len(begins) else owners[:0]
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[begins], first, place


def _send_anchors(length: int, groups: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        anchors = np.sort(_bucket(table, length).anchors)
        return _dealt(key[0].as_py(), groups, anchors[_new(anchors)])

    return run


def _returned(table: pa.Table, keep: np.ndarray) -> pa.Table:
    """The kept hashes of every row, to its bucket."""
    lengths = pc.list_value_length(table.column("hashes")).to_numpy()
    total = np.concatenate(([0], np.cumsum(keep)))
    ends = np.concatenate(([0], np.cumsum(lengths)))
    offsets = total[ends].astype(np.int32)
    hashes = np.asarray(pc.list_flatten(table.column("hashes")))[keep]
    out = pa.table({"bucket": table.column("bucket"), "hashes": pa.ListArray.from_arrays(offsets, pa.array(hashes))})
    return out.filter(pa.array(np.diff(offsets) > 0))


def _shared_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    hashes = np.asarray(pc.list_flatten(table.column("hashes")))
    order = np.argsort(hashes)
    new = _new(hashes[order])
    several = np.empty(len(hashes), bool)
    several[order] = ~(new & np.append(new[1:], True))
    return _returned(table, several)


def _send_windows(length: int, groups: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, shared: pa.Table) -> pa.Table:
        mine = _bucket(table, length)
        on = _among(mine.anchors, _merged(shared.column("hashes")))
        hashes, firsts, _ = _first_owner(mine.windows[on], mine.owners[on])
        return _dealt(key[0].as_py(), groups, hashes, firsts)

    return run


def _repeated_windows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    hashes = np.asarray(pc.list_flatten(table.column("hashes")))
    firsts = np.asarray(pc.list_flatten(table.column("firsts")))
    _, first, place = _first_owner(hashes, firsts)
    return _returned(table, first[place] < firsts)


def _mark(length: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, repeated: pa.Table) -> pa.Table:
        mine = _bucket(table, length)
        _, first, place = _first_owner(mine.windows, mine.owners)
        covered = mine.places[(first[place] < mine.owners) | _among(mine.windows, _merged(repeated.column("hashes")))]
        total = int(mine.word_borders[-1])
        change = np.zeros(total + length + 1, np.int64)
        change[covered] += 1
        change[covered + length] -= 1
        gone = np.cumsum(change)[:total] > 0
        kept, removed, found = [], [], []
        for i, (low, high) in enumerate(zip(mine.word_borders, mine.word_borders[1:], strict=False)):
            text = mine.data[mine.borders[i] : mine.borders[i + 1]].tobytes().split()
            flags = gone[low:high]
            if flags.any():
                text = [w for w, cut in zip(text, flags.tolist(), strict=True) if not cut]
            kept.append(b" ".join(text))
            removed.append(int(flags.sum()))
            edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
            found.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_words": pa.array(np.diff(mine.word_borders).astype(np.int64)),
                "n_removed": pa.array(removed, pa.int64()),
                "removed": pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    return run


def remove_repeats(docs: DataFrame, length: int = 13, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Drop words in windows of ``length`` words that start in a smaller document too.

    Takes (doc_id, text); returns doc_id, n_words, n_removed, ``removed`` (word
    ranges of maximal repeats) and ``kept`` (the other words, joined by one
    space). A null text has no words. A null doc_id is smaller than any other.
    Rows that share a doc_id count as one document. Windows are judged on the
    input. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // bucket_bytes))
    groups = -(-buckets // BUCKETS_A_GROUP)
    placed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).alias("bucket"))
    by_bucket = placed.groupBy("bucket")
    back = "bucket long, hashes array<long>"
    shared = (
        by_bucket.applyInArrow(_send_anchors(length, groups), f"dealt long, {back}")
        .groupBy("dealt").applyInArrow(_shared_anchors, back)
    )
    repeated = (
        by_bucket.cogroup(shared.groupBy("bucket"))
        .applyInArrow(_send_windows(length, groups), f"dealt long, {back}, firsts array<long>")
        .groupBy("dealt").applyInArrow(_repeated_windows, back)
    )
    return by_bucket.cogroup(repeated.groupBy("bucket")).applyInArrow(
        _mark(length),
        "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept string",
    )


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 13 words and more taken out of all documents."""
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE_SQL = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
    SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win
    FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM docs WHERE len(w) >= 13)
), firsts AS (
    SELECT win, min(doc_id) AS first FROM starts GROUP BY win
), gone AS (
    SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p
    FROM starts JOIN firsts USING (win) WHERE first < doc_id
), marks AS (
    SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(
           list_transform(list_filter(generate_series(1, len(w)), lambda k: NOT list_contains(ps, k)), lambda k: w[k]), ' ') END
       ) AS kept_sha256
FROM docs d LEFT JOIN marks m ON d.doc_id = m.doc_id
"""
