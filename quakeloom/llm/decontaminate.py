"""Benchmark decontamination by a broadcast set of normalised n-grams.

The benchmark's windows, with a 64-bit key each, form a small table, counted
before it is broadcast. Beyond ``max_windows`` both sides are shuffled: a place
in a document then goes as two 64-bit keys, without the document's words.
Documents are cut into words; every window's key is looked up in the hash table
inside one stage, and a hit is verified word by word at once, so only true
hits leave the scan. Nothing but them is shuffled, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm.tables import documents, table
from quakeloom.llm.text import BETWEEN_CASED, WORD_CASED, word_list

LENGTH = 10
MAX_WINDOWS = 1 << 20


def _key(words: Column, place: Column, length: int, *salt: Column) -> Column:
    return F.xxhash64(*salt, *[F.get(words, place + i) for i in range(length)])


def benchmark_windows(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """Different windows of all items: key, n, window, item_ids. Items of fewer
    words, but not none, are one window; null texts have none."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), word_list(F.col("text")).alias("words")).filter("size(words) > 0")
    n = F.least(F.size("words"), F.lit(length))
    cut = words.select("item_id", n.alias("n"), F.posexplode("words").alias("place", "word"), "words").filter(
        "place + n <= size(words)"
    ).select("item_id", "n", F.slice("words", F.col("place") + 1, F.col("n")).alias("window"))
    key = F.coalesce(*[F.when(F.col("n") == k, _key(F.col("window"), F.lit(0), k)) for k in range(1, length + 1)])
    return cut.groupBy("window", "n").agg(F.collect_set("item_id").alias("item_ids")).withColumn("key", key)


def hits(docs: DataFrame, windows: DataFrame, keys: list[str], max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Verified places of windows in documents: keys, place, n, item_ids.

    A window of a broadcast table is verified by its words, one of a larger
    table by the second of two keys, 128 bits together.
    """
    lengths = {r["n"]: r["count"] for r in windows.groupBy("n").count().collect()}  # at most LENGTH rows
    small = sum(lengths.values()) <= max_windows
    words = docs.select(*keys, word_list(F.col("text")).alias("words"))
    # The outer form, as the inner one lets the planner cut the text once more for a filter.
    placed = words.select(*keys, "words", F.posexplode_outer("words").alias("place", "word"))
    each = sorted(lengths) or [LENGTH]
    if len(each) == 1:
        asked = placed.filter(F.col("place") + each[0] <= F.size("words")).select(
            *keys, "words", "place", F.lit(each[0]).alias("n"), _key(F.col("words"), F.col("place"), each[0]).alias("key")
        )
    else:
        asked = placed.select(
            *keys, "words", "place",
            F.explode(F.array(*[
                F.struct(F.lit(k).alias("n"), _key(F.col("words"), F.col("place"), k).alias("key")) for k in each
            ])).alias("_w"),
        ).select(*keys, "words", "place", "_w.n", "_w.key").filter("place + n <= size(words)")
    if not small:
        def second(words: str, place: Column) -> Column:
            return F.coalesce(*[F.when(F.col("n") == k, _key(F.col(words), place, k, F.lit("second"))) for k in each])

        narrow = asked.select(*keys, "place", "n", "key", second("words", F.col("place")).alias("second"))
        listed = windows.select("key", "n", second("window", F.lit(0)).alias("second"), "item_ids")
        return narrow.join(listed, ["key", "second", "n"]).select(*keys, "place", "n", "item_ids")
    # Equality, put so that it is tested after the look-up and not made part of its key.
    mine = F.slice("words", F.col("place") + 1, F.col("n"))
    return (
        asked.join(F.broadcast(windows), ["key", "n"])
        .filter((mine >= F.col("window")) & (mine <= F.col("window")))
        .select(*keys, "place", "n", "item_ids")
    )


def contamination(docs: DataFrame, items: DataFrame, length: int = LENGTH, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per document with hits: doc_id, _text (hash of the text), ``spans``
    (merged word ranges), ``n_hit`` (words in them) and ``item_ids``."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")
    found = hits(keyed, benchmark_windows(items, length), ["doc_id", "_text"], max_windows).groupBy("doc_id", "_text").agg(
        F.array_sort(F.collect_set(F.struct(F.col("place").alias("start"), (F.col("place") + F.col("n")).alias("end")))).alias("places"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"),
    )
    # Places are sorted, so each either reaches into the last range or begins a new one.
    merged = F.expr("""
        aggregate(places, cast(array() as array<struct<start: int, end: int>>), (done, p) ->
            if(size(done) > 0 and p.start <= element_at(done, -1).end,
               concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).start as start,
                      greatest(element_at(done, -1).end, p.end) as end))),
               concat(done, array(p))))
    """)
    return found.select("doc_id", "_text", merged.alias("spans"), "item_ids").withColumn(
        "n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    )


def _joined(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Each row of docs whole, as ``_row`` (so that no name can clash), with what was found in it."""
    left = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_left"), F.xxhash64("text").alias("_left_hash"))
    right = found.withColumnsRenamed({"doc_id": "_right", "_text": "_right_hash"})
    on = F.col("_left").eqNullSafe(F.col("_right")) & (F.col("_left_hash") == F.col("_right_hash"))
    return left.join(right, on, how)


def drop_contaminated(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """Documents without any hit; all columns stay."""
    narrow = docs.select("doc_id", "text")
    return _joined(docs, contamination(narrow, items, length), "left_anti").select("_row.*")


def cut_contaminated(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """All documents, with the words of hits (and what follows each up to the
    next word) cut from ``text``; all columns stay."""
    joined = _joined(docs, contamination(docs.select("doc_id", "text"), items, length), "left")
    # The text is cut once: what stands before its first word, and each word with what follows it.
    # The outer transform binds these, so that the kept stretches between spans are slices of them.
    cut = F.expr(f"""
        case when spans is null then _row.text else element_at(transform(
            array(struct(
                split(_row.text, r'{WORD_CASED}') as between,
                array_remove(split(_row.text, r'{BETWEEN_CASED}'), '') as words,
                concat(array(0), transform(spans, s -> s.end)) as froms,
                transform(spans, s -> s.start) as upto)),
            t -> element_at(transform(
                array(struct(
                    zip_with(t.words, slice(t.between, 2, size(t.words)), (w, after) -> concat(w, after)) as pieces,
                    zip_with(t.froms, concat(t.upto, array(size(t.words))), (a, b) -> struct(a as at, b - a as n)) as kept)),
                u -> concat(element_at(t.between, 1),
                            array_join(flatten(transform(u.kept, k -> slice(u.pieces, k.at + 1, k.n))), ''))), 1)), 1) end
    """)
    return joined.select(*[cut.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in 10-word windows of the benchmark.

    A null text has no words; rows that repeat a doc_id are judged one by one;
    with an empty benchmark nothing is hit.
    """
    docs = documents(spark, sf_dir)
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    counted = docs.select("doc_id", F.size(word_list(F.col("text"))).cast("long").alias("n_words"), "text")
    items = F.coalesce("item_ids", F.array().cast("array<string>"))
    return _joined(counted, found, "left").select(
        "_row.doc_id",
        "_row.n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH lowered AS (
    SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), cut AS (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i
    FROM items WHERE len(w) > 0
), grams AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM cut
), sizes AS (SELECT DISTINCT n FROM grams
), places AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM lowered, sizes WHERE len(w) >= n)
), found AS (
    SELECT doc_id, n, i, item_id FROM places JOIN grams USING (n, win)
), words_hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id
), items_hit AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items,
           array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM found GROUP BY doc_id
)
SELECT l.doc_id, len(l.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""
