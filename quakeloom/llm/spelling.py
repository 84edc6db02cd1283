"""Spelling variants by a relational trie frontier.

The vocabulary forms two tries, one over the words and one over the words
reversed. Each is a distributed table of nodes with their edges; a node is known
by a hash of its prefix. Pairs of words at distance one share the first or the
second half of a word, so states (word, position, node, edits) start in the
middle of the word, once in either trie, and one edit is allowed from there on.
Level by level the states are joined with the edge table: a state without an
edit follows the word's own path and branches at every other edge into a
replaced, an inserted or a deleted code point; a state with its edit follows
the one edge that fits. An edit is made only where word and path part, so that
a pair is reached once in a trie.

An edge that only one word goes through ends the walk: the rest of that word is
compared at once. A node's edges also say which code points can follow, and
states that cannot go on are not made. Equal hashes can only add states; every
pair is verified by its words at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm.arrow import map_arrow
from quakeloom.llm.tables import documents
from quakeloom.llm.text import ascii_lower
from quakeloom.llm.words import hashes
from quakeloom.session import staged

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
DELETE_EVERY = 199
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Stands behind every word, so that all transitions look alike. No letter of a word.
END = "\x00"
#: Rests of this many code points are kept with an edge; longer ones are compared at the end.
REST = 48


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): lower-cased runs of letters of all texts, counted.

    One in ``DELETE_EVERY`` hashes of (doc_id, run) loses a code point. A null
    text has no runs; a null doc_id is hashed as an empty text.
    """
    run, h = F.col("run"), F.col("h")
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(RUN), F.lit(0))).alias("run"),
    ).filter(F.length("run") >= min_length)
    at = (h % F.length(run)).cast("int")
    damaged = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    words = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), run))).select(
        F.when(h % DELETE_EVERY == 0, damaged).otherwise(run).alias("word")
    )
    return (
        words.filter(F.length("word") >= min_length)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
    )


# -- the tries ---------------------------------------------------------------------------------------


def _oriented(batch: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[int, str, np.ndarray]]]]:
    """For either side: (id, word in its direction with END, hashes of all its prefixes).
    A word's id is the hash of the whole word, read forwards."""
    words = batch.column("word").to_pylist()
    ids: list[int] = []
    for side in (0, 1):
        turned = [(w[::-1] if side else w) + END for w in words]
        data = np.frombuffer("".join(turned).encode("utf-32-le"), np.uint8)
        lengths = np.array([len(w) for w in turned])
        borders = np.concatenate([[0], np.cumsum(lengths)])
        starts = np.repeat(borders[:-1], lengths)
        ends = np.arange(1, borders[-1] + 1)
        found = hashes(data, 4 * starts, 4 * ends, max(1 << 19, 8 * int(lengths.max(initial=0)))).view(np.int64)
        ids = ids or found[borders[1:] - 1].tolist()
        yield side, list(zip(ids, turned, np.split(found, borders[1:-1]), strict=True)) if words else []


STATE = "side int, id long, rest string, pos int, node long, edits int"
EDGE = "side int, parent long, letter string, child long, follows long, id long, rest string"


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A state in the middle of every word, for either side."""
    for batch in batches:
        rows = []
        for side, words in _oriented(batch):
            for number, word, node in words:
                half = (len(word) - 1) // 2
                start = len(word) - 1 - half if side else half
                rows.append((side, number, word[start:], start, int(node[start - 1]) if start else 0, 0))
        yield _batch(rows, STATE)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word's path, from the least depth at which a near word can start."""
    for batch in batches:
        for side, words in _oriented(batch):
            rows = []
            for number, word, node in words:
                node = node.tolist()
                for at in range(max(0, len(word) // 2 - 1), len(word)):
                    rest = word[at + 1 : at + 2 + REST]
                    follows = _bit(rest[0]) if rest else 0
                    rows.append((side, node[at - 1] if at else 0, word[at], node[at], follows, number, rest if len(rest) <= REST else None))
                if len(rows) >= 1 << 16:
                    yield _batch(rows, EDGE)
                    rows = []
            yield _batch(rows, EDGE)


def _bit(letter: str) -> int:
    at = ord(letter) & 63
    return 1 << at if at < 63 else -(1 << 63)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def edge_table(words: DataFrame) -> DataFrame:
    """(side, node, edges): nodes that two words or more go through. An edge has its
    letter, child, the letters that can follow, and the only word through it, if one."""
    edges = (
        map_arrow(words.select("word"), _edges, EDGE)
        .groupBy("side", "parent", "letter", "child")
        .agg(F.count(F.lit(1)).alias("size"), F.bit_or("follows").alias("follows"), F.min("id").alias("only"), F.min("rest").alias("rest"))
    )
    alone = (F.col("size") == 1) | (F.col("letter") == END)
    edge = F.struct(
        "letter", "child", "follows", F.when(alone, F.col("only")).alias("only"), F.when(alone, F.col("rest")).alias("rest")
    )
    return (
        edges.groupBy("side", F.col("parent").alias("node"))
        .agg(F.collect_list(edge).alias("edges"), F.sum("size").alias("size"))
        .filter(F.col("size") > 1)
        .select("side", "node", "edges")
    )


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """One level: states joined with the edges of their nodes. ``found`` is the word at the
    end of a walk; states without it go on."""
    e, rest, fresh = F.col("e"), F.col("rest"), F.col("edits") == 0
    letter, alone = e["letter"], e["only"].isNotNull()
    code = [F.col(f"c{i}") for i in range(3)]

    def left(taken: int) -> Column:
        return F.substring(rest, F.lit(taken + 1), F.length(rest)) if taken else rest

    def fits(taken: int) -> Column:
        """Can the walk go on, or does it end at the edge's only word?"""
        same = F.when(e["rest"].isNull(), F.length(rest) - taken > REST).otherwise(e["rest"] == left(taken))
        next_bit = F.bit_get(e["follows"], F.ascii(code[taken]).bitwiseAND(F.lit(63)))
        return F.when(alone, (e["only"] != F.col("id")) & same).otherwise((code[taken] != "") & (next_bit == 1))

    def move(name: str, taken: int, edits: Column) -> Column:
        return F.when(F.col(name), F.struct(left(taken).alias("rest"), (F.col("pos") + taken).alias("pos"), edits.alias("edits")))

    # All edges of a node are weighed, so what cannot fit goes before anything is made of it.
    other = fresh & (letter != code[0])
    weighed = (
        states.join(edges, ["side", "node"])
        .select("side", "id", "pos", "rest", "edits", *[F.substring("rest", i + 1, 1).alias(f"c{i}") for i in range(3)], "edges")
        .select("*", F.explode("edges").alias("e"))
        .drop("edges")
        .filter(fresh | (letter == code[0]))
        .withColumns(
            {
                "same": (letter == code[0]) & ~(alone & fresh) & fits(1),
                "replaced": other & (letter != END) & (code[0] != END) & fits(1),
                "inserted": other & (letter != END) & fits(0),
                "deleted": other & (code[0] != END) & (letter == code[1]) & fits(2),
            }
        )
        .filter("same or replaced or inserted or deleted")
    )
    moves = F.array(
        move("same", 1, F.col("edits")),
        move("replaced", 1, F.lit(1)),
        move("inserted", 0, F.lit(1)),
        move("deleted", 2, F.lit(1)),
    )
    m = F.col("m")
    return weighed.select("side", "id", "e", F.explode(F.filter(moves, lambda x: x.isNotNull())).alias("m")).select(
        "side",
        "id",
        m["rest"].alias("rest"),
        m["pos"].cast("int").alias("pos"),
        e["child"].alias("node"),
        m["edits"].cast("int").alias("edits"),
        e["only"].alias("found"),
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all words of ``words`` (word, n; no word twice) at distance one
    from each word. There are as many levels as two different words share code points,
    less their first halves."""
    edges = staged(edge_table(words))
    states = map_arrow(words.select("word"), _states, STATE)
    ends = []
    while True:
        reached = staged(_step(states, edges))
        ends.append(reached.filter(F.col("found").isNotNull()).select("id", "found"))
        states = reached.filter(F.col("found").isNull()).drop("found")
        if states.isEmpty():
            break
    pairs = reduce(DataFrame.unionAll, ends).distinct()
    known = map_arrow(words, _identified, "id long, word string, n long")
    return (
        pairs.join(known.select("id", "word"), "id")
        .join(known.select(F.col("id").alias("found"), F.col("word").alias("near"), F.col("n").alias("near_n")), "found")
        .filter(F.levenshtein("word", "near", 1) == 1)
        .select("word", "near", "near_n")
    )


def _identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ids = pa.array([number for number, _, _ in next(_oriented(batch))[1]], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, batch.column("word"), batch.column("n")], ["id", "word", "n"])


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root for every row of ``words`` (word, n).

    ``form`` is the most frequent near word, at least ``ratio`` times as frequent;
    ``root`` is the last of the chain of forms. A chain grows by ``ratio`` at each
    link, so its length is bounded by the logarithm of the largest count.
    """
    near = (
        near_pairs(words)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    )
    best = F.when(-F.col("best.minus") >= ratio * F.col("n"), F.col("best"))
    formed = staged(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            best["near"].alias("form"),
            (-best["minus"]).alias("form_n"),
        )
    )
    # Only words with a form have a way to go; its length doubles each time.
    way = formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        further = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(way.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        way = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return formed.join(way, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents; see ``vocabulary`` and ``spelling_variants``.

    Repeated rows count as often as they occur; an empty table has no words.
    """
    return spelling_variants(staged(vocabulary(documents(spark, sf_dir))))


#: The checksum is put together from what every byte adds to it by its distance from
#: the end; near words lose the same code point, or one of them loses one to be the other.
ORACLE_SQL = f"""
WITH RECURSIVE bits(b, c, k) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
),
bytes AS (SELECT b, c AS t FROM bits WHERE k = 8),
found AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents
),
runs AS (SELECT id, run, count(*) AS times FROM found WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
hexed AS (SELECT id, run, hex(encode(id || run)) AS hex FROM runs),
placed AS (SELECT id, run, length(hex) // 2 AS size, hex, unnest(range(length(hex) // 2)) AS i FROM hexed),
parts AS (
  SELECT id, run, size, size - 1 - i AS d,
    16 * (strpos('0123456789ABCDEF', substr(hex, CAST(2 * i + 1 AS BIGINT), 1)) - 1) + strpos('0123456789ABCDEF', substr(hex, CAST(2 * i + 2 AS BIGINT), 1)) - 1 AS b
  FROM placed
),
far AS (SELECT max(size) AS size FROM parts),
moved(b, d, t) AS (
  SELECT b, 0::BIGINT, t FROM bytes
  UNION ALL SELECT m.b, d + 1, xor(m.t >> 8, y.t) FROM moved m JOIN bytes y ON y.b = m.t & 255 WHERE d < (SELECT size FROM far)
),
start(d, t) AS (
  SELECT 0::BIGINT, 4294967295::BIGINT
  UNION ALL SELECT d + 1, xor(s.t >> 8, y.t) FROM start s JOIN bytes y ON y.b = s.t & 255 WHERE d < (SELECT size FROM far)
),
hashed AS (
  SELECT id, run, xor(xor(bit_xor(m.t), any_value(s.t)), 4294967295) AS h
  FROM parts p JOIN moved m ON m.b = p.b AND m.d = p.d JOIN start s ON s.d = p.size GROUP BY id, run
),
kept AS (
  SELECT CASE WHEN h % {DELETE_EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times
  FROM hashed JOIN runs USING (id, run)
),
v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM kept WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(times) >= {MIN_COUNT}),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS key FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.key = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.key = b.word
),
formed AS (
  SELECT v.word, v.n, count(near) AS n_near, first(near ORDER BY near.n DESC, encode(near)) AS best, max(near.n) AS best_n
  FROM v LEFT JOIN near USING (word) GROUP BY v.word, v.n
),
forms AS (SELECT word, n, n_near, CASE WHEN best_n >= {RATIO} * n THEN best END AS form, CASE WHEN best_n >= {RATIO} * n THEN best_n END AS form_n FROM formed),
chain(word, last, form) AS (
  SELECT word, word, form FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.form
)
SELECT f.word, f.form, c.last AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
