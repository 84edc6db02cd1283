"""Jaccard join of documents on word n-grams with Bayesian candidate pruning.

1. Equal texts become one node, so copies cost nothing below.
2. Every node gets MinHash values. Nodes that agree on all values of a band are
   candidates: 30 bands of 5 values miss a pair of similarity 0.8 seven times in
   a million, and a more similar one less often.
3. Candidate pairs compare one byte of each value, 30 at a time. A pair is
   dropped as soon as the posterior probability that its similarity reaches the
   threshold, given the matches so far and a uniform prior, is under tolerance.
4. What is left is verified on the n-gram sets themselves.

A band's bucket of at most ``SMALL`` nodes gives its pairs, each kept once.
Nodes of larger buckets form families (components of those buckets). A family
is dealt into blocks of about ``BLOCK`` nodes; each pair of blocks is compared
in one task, which returns a count of links and a spanning forest per node, so
a group of near copies is neither collected nor spelled out as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm import words
from quakeloom.llm.arrow import bytes_of, map_arrow, slices
from quakeloom.llm.tables import documents
from quakeloom.operators.distributed import connected_components
from quakeloom.session import ship_package, staged

THRESHOLD = 0.8
TOLERANCE = 1e-6
SHINGLE = 5
BANDS, ROWS = 30, 5
STEP = 30
SMALL = 16
BLOCK = 512
NO_ID = -(1 << 63)
SLICE_BYTES = 1 << 20


@cache
def _multipliers() -> np.ndarray:
    return np.random.default_rng(10).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Hashes of the word n-grams of every text, repeats included. A text of
    fewer words, but not none, has one of all its words."""
    data, borders = bytes_of(texts)
    starts, ends, word_borders = words.spans(data, borders)
    hashed = words.hashes(data, starts, ends)
    found = words.windows(hashed, size)
    out = []
    for low, high in zip(word_borders[:-1].tolist(), word_borders[1:].tolist(), strict=True):
        short = 0 < high - low < size
        out.append(words.windows(hashed[low:high], high - low) if short else found[low : max(low, high - size + 1)])
    return out


def _minima(values: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 1024):
        np.minimum(least, (values[i : i + 1024, None] * _multipliers()).min(axis=0), out=least)
    return least


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and bands of every text that has words."""
    for batch in batches:
        for piece in slices(batch, "text", SLICE_BYTES):
            found = shingles(piece.column("text"))
            has = np.array([len(x) > 0 for x in found], bool)
            least = np.array([_minima(x) for x in found if len(x)], np.uint64).reshape(-1, BANDS * ROWS)
            mixed = words.mix(least)
            bands = np.zeros((len(least), BANDS), np.uint64)
            for i in range(ROWS):
                bands = bands * words.STEP + mixed.reshape(-1, BANDS, ROWS)[:, :, i]
            bands = words.mix(bands + np.arange(BANDS, dtype=np.uint64))
            low = mixed.astype(np.uint8)
            signs, lists = np.full(len(found), None, object), np.full(len(found), None, object)
            for at, row in enumerate(np.flatnonzero(has)):
                signs[row], lists[row] = low[at].tobytes(), bands[at].view(np.int64)
            yield pa.record_batch(
                {
                    "doc_id": piece.column("doc_id"),
                    "node": piece.column("node"),
                    "sign": pa.array(signs, pa.binary()),
                    "bands": pa.array(lists, pa.list_(pa.int64())),
                }
            )


@cache
def needed_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[tuple[int, int], ...]:
    """(values compared, fewest matches with which a pair stays).

    A byte matches with probability s = J + (1 - J) / 256. With J uniform, the
    posterior of s after m matches of n is a Beta(m + 1, n - m + 1) on
    [1/256, 1]; its tails are sums of a binomial distribution.
    """

    def above(x: Fraction, m: int, n: int) -> Fraction:
        """P(Beta(m + 1, n - m + 1) > x) = P(Binomial(n + 1, x) <= m)."""
        return sum((comb(n + 1, j) * x**j * (1 - x) ** (n + 1 - j) for j in range(m + 1)), Fraction(0))

    floor = Fraction(1, 256)
    reach = Fraction(threshold).limit_denominator(10**6)
    reach = reach + (1 - reach) * floor
    steps = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        low, high = 0, n
        while low < high:
            middle = (low + high) // 2
            if above(reach, middle, n) / above(floor, middle, n) >= Fraction(tolerance):
                high = middle
            else:
                low = middle + 1
        steps.append((n, low))
    return tuple(steps)


def _survivors(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, steps: tuple) -> np.ndarray:
    """Which of the pairs (left[i], right[i]) of rows of a and b stay."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for n, least in steps:
        matches = matches + (a[left[alive], done:n] == b[right[alive], done:n]).sum(axis=1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def _prune(steps: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = [
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
                for c in ("sign_a", "sign_b")
            ]
            rows = np.arange(batch.num_rows)
            yield batch.select(["a", "b"]).take(pa.array(_survivors(*signs, rows, rows, steps)))

    return run


def _reaches(shared: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Is shared / (sum of the sizes - shared) at least the threshold? In integers."""
    t = Fraction(threshold).limit_denominator(10**6)
    return shared * t.denominator >= (sizes - shared) * t.numerator


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text_a", SLICE_BYTES):
                pairs = zip(shingles(piece.column("text_a")), shingles(piece.column("text_b")), strict=True)
                keep = []
                for x, y in pairs:
                    x, y = np.unique(x), np.unique(y)
                    shared = np.intersect1d(x, y, assume_unique=True)
                    keep.append(bool(_reaches(np.int64(len(shared)), np.int64(len(x) + len(y)), threshold)))
                yield piece.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_pair(steps: tuple, threshold: float):
    """Links and a spanning forest among the nodes of one block, or between two."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        # Pyspark hands over the group's rows; a block has about BLOCK of them.
        block = table.column("block").to_numpy()
        signs = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(-1, BANDS)
        first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
        left, right = [], []
        for i in first.tolist():
            others = second[second > i] if low == high else second
            same = (bands[others] == bands[i]).any(axis=1)
            right.append(others[same])
            left.append(np.full(int(same.sum()), i))
        left, right = np.concatenate([np.empty(0, int), *left]), np.concatenate([np.empty(0, int), *right])
        alive = [
            i + _survivors(signs, signs, left[i : i + 65536], right[i : i + 65536], steps) for i in range(0, len(left), 65536)
        ]
        alive = np.concatenate([np.empty(0, int), *alive])
        left, right = left[alive], right[alive]
        linked = _verified(table.column("text").combine_chunks(), left, right, threshold)
        left, right = left[linked], right[linked]
        links = np.bincount(left, minlength=len(block)) + np.bincount(right, minlength=len(block))
        root = list(range(len(block)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        nodes = table.column("node").to_pylist()
        return pa.table(
            {
                "node": table.column("node"),
                "links": pa.array(links, pa.int64()),
                "root": pa.array([nodes[find(i)] for i in range(len(nodes))], pa.binary()),
            }
        )

    return run


def _verified(texts: pa.Array, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Flags of the pairs that reach the threshold, by products of the 0/1 matrix
    of rows and those n-grams that several rows have."""
    if not len(left):
        return np.zeros(0, bool)
    rows = np.unique(np.concatenate((left, right)))
    found = [np.unique(x) for x in shingles(texts.take(pa.array(rows)))]
    sizes = np.array([len(x) for x in found], np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    grams, column, count = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    several = count[column] > 1
    owner, column = owner[several], (np.cumsum(count > 1) - 1)[column[several]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(rows), len(rows)), np.float32)
    width = 4096
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [begin, begin + width])
        part = np.zeros((len(rows), width), np.float32)
        part[owner[a:b], column[a:b] - begin] = 1
        shared += part @ part.T
    x, y = np.searchsorted(rows, left), np.searchsorted(rows, right)
    return _reaches(shared[x, y].astype(np.int64), sizes[x] + sizes[y], threshold)


def node_of(text: Column) -> Column:
    """The identity of a text: 128 bits; null of a null text."""
    return F.unhex(F.md5(text))


def similar(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The join of (doc_id, text) with itself, in three staged tables.

    (doc_id, node) of every row with a text; (node, n_links) of nodes with
    links; and edges (a, b) that connect the same nodes as all links do.
    """
    spark = docs.sparkSession
    ship_package(spark)
    steps = needed_matches(threshold, tolerance)
    keyed = docs.select("doc_id", "text", node_of(F.col("text")).alias("node")).filter("text is not null")
    signed = staged(map_arrow(keyed, _sign, "doc_id long, node binary, sign binary, bands array<long>"))
    nodes = staged(
        signed.filter("sign is not null").groupBy("node").agg(F.first("sign").alias("sign"), F.first("bands").alias("bands"))
    )
    # Joins of what grows with the corpus are hinted as sort-merge joins: below the
    # broadcast limit the planner would take another way, with other costs.
    bands = nodes.select("node", F.explode("bands").alias("band"))
    buckets = staged(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter("n > 1"))

    # Families of large buckets: each node is tied to its bucket's least one.
    ties = bands.join(buckets.filter(F.col("n") > SMALL).hint("merge"), "band").select(F.col("node").alias("a"), F.col("least").alias("b"))
    family = staged(connected_components(ties).toDF("node", "family"))

    # Pairs of small buckets, unless both are of one family.
    listed = bands.join(buckets.filter(F.col("n") <= SMALL).hint("merge"), "band").groupBy("band").agg(
        F.array_sort(F.collect_list("node")).alias("s")
    )
    pairs = listed.select(F.explode(F.expr(
        "flatten(transform(sequence(0, size(s) - 2), i -> transform(slice(s, i + 2, size(s)), y -> struct(s[i] as a, y as b))))"
    )).alias("p")).select("p.a", "p.b").distinct()
    of_a, of_b = family.toDF("a", "family_a"), family.toDF("b", "family_b")
    pairs = pairs.join(of_a, "a", "left").join(of_b, "b", "left").filter(
        "family_a is null or family_b is null or family_a <> family_b"
    ).select("a", "b")
    signs = nodes.select("node", "sign")
    signed_pairs = pairs.join(signs.toDF("a", "sign_a"), "a").join(signs.toDF("b", "sign_b"), "b").select("a", "b", "sign_a", "sign_b")
    likely = staged(map_arrow(signed_pairs, _prune(steps), "a binary, b binary"))

    # The texts that are still needed, once each.
    needed = likely.select(F.col("a").alias("node")).union(likely.select("b")).union(family.select("node")).distinct()
    texts = staged(keyed.select("node", "text").join(needed.hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    with_texts = likely.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    links = staged(map_arrow(with_texts, _verify(threshold), "a binary, b binary"))

    sizes = family.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    members = (
        family.join(sizes, "family").join(nodes, "node").join(texts, "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "text", "sign", "bands")
    )
    grouped = staged(
        members.groupBy("family", "low", "high").applyInArrow(_block_pair(steps, threshold), "node binary, links long, root binary")
        .filter("links > 0")
    )
    counts = (
        grouped.select("node", "links")
        .union(links.select(F.col("a").alias("node"), F.lit(1).cast("long").alias("links")))
        .union(links.select("b", F.lit(1).cast("long")))
        .groupBy("node").agg(F.sum("links").alias("n_links"))
    )
    edges = links.union(grouped.select("node", "root"))
    return signed.select("doc_id", "node"), staged(counts), edges


def classes_of_nodes(
    docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> tuple[DataFrame, DataFrame]:
    """Rows with a text (doc_id, node, _id), and one row a text: node, copy_of,
    class_id, n_links, leader (the node of its class that stands for it).

    A null doc_id is ``NO_ID``. Of the texts of a class that share its least
    doc_id, the one of the least node leads.
    """
    rows, counts, edges = similar(docs, threshold, tolerance)
    component = staged(connected_components(edges).toDF("node", "component"))
    own = rows.select(F.col("doc_id"), "node", F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"))
    # One row a text.
    copies = own.groupBy("node").agg(F.min("_id").alias("copy_of"))
    known = copies.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min(F.struct("copy_of", "node")).alias("_least")).select(
        "component", F.col("_least.copy_of").alias("class_id"), F.col("_least.node").alias("leader")
    )
    # Staged, so that the join with a text's many copies has a plain exchange on either side and can be split.
    return own, staged(known.join(least, "component").join(counts, "node", "left").select(
        "node", "copy_of", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "leader"
    ))


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, node, class_id, copy_of, n_links.

    ``class_id`` is the least doc_id that the row is connected to by equal texts
    and links; ``copy_of`` the least one with an equal text; ``n_links`` how
    many other texts reach the threshold with its own. Texts without words are
    linked to none. A null text is alone, its node is null and its doc_id stands
    for both ids. A null doc_id counts as the least.
    """
    own, by_node = classes_of_nodes(docs, threshold, tolerance)
    back = [F.when(F.col(c) != NO_ID, F.col(c)).alias(c) for c in ("class_id", "copy_of")]
    grouped = own.join(by_node.drop("leader").hint("merge"), "node").select("doc_id", "node", *back, "n_links")
    alone = docs.filter("text is null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("node"),
        F.col("doc_id").cast("long").alias("class_id"), F.col("doc_id").cast("long").alias("copy_of"), F.lit(0).cast("long").alias("n_links"),
    )
    return grouped.unionByName(alone)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The document of the least doc_id of every class, with all columns, and all null texts.

    Classes are told apart by their texts, so those of rows that share a doc_id,
    or have none, keep a document each.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    _, by_node = classes_of_nodes(narrow, threshold, tolerance)
    kept = by_node.filter("node = leader").select(F.col("copy_of").alias("_id"), F.col("node").alias("_node"))
    held = docs.filter("text is not null").select(
        F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), node_of(F.col("text")).alias("_node")
    )
    # Rows that repeat a document whole (id and text) are one document.
    picked = held.join(kept, ["_id", "_node"], "left_semi").dropDuplicates(["_id", "_node"]).select("_row.*")
    return picked.union(docs.filter("text is null"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their class and number of links at 0.8 on five words."""
    return similarity_classes(documents(spark, sf_dir)).drop("node")


ORACLE_SQL = r"""
WITH RECURSIVE texts AS (
    SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text
), cut AS (
    SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts
), grams AS (
    SELECT DISTINCT id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
    FROM (SELECT id, w, unnest(generate_series(1, len(w) - least(len(w), 5) + 1)) AS i FROM cut WHERE len(w) > 0)
), sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id
), shared AS (
    SELECT a.id AS x, b.id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.id <> b.id GROUP BY ALL
), links AS (
    SELECT x, y FROM shared JOIN sizes a ON a.id = x JOIN sizes b ON b.id = y WHERE c * 5 >= (a.n + b.n - c) * 4
), reach AS (
    SELECT id AS x, id AS y FROM texts UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), classes AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x
), counts AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(t.id, d.doc_id) AS copy_of, coalesce(n.n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN texts t ON d.text = t.text LEFT JOIN classes c ON c.x = t.id LEFT JOIN counts n ON n.x = t.id
"""
