"""License scan by ordered signature rules.

A cheap test on lower-cased text picks the documents that may name a license.
Their text is normalised to words with one space between, and a rule is tried
only where its keyword occurs. Matches are word intervals. Of overlapping
detections, one that lies within another of no lower priority is suppressed:
with intervals in order of start (longer and stronger ones first), it is one
whose end does not pass the farthest end before it, so a running maximum per
priority settles all of them in one sorted pass per document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeloom.llm.license_rules import GATE, Rule, rules
from quakeloom.llm.tables import documents, literal_table
from quakeloom.llm.text import ascii_lower, word_list

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_CONFIDENCE = 0.6


def _spaces(text: str) -> str:
    return f"(length({text}) - length(replace({text}, ' ', '')))"


def detections(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Surviving matches: keys, label, rule, priority, confidence, start and end (words, end exclusive)."""
    spark = docs.sparkSession
    table = literal_table(spark, Rule._fields, rules())
    keywords = sorted({r.keyword for r in rules()})
    words = F.array_join(word_list(F.col("text")), " ")
    gated = docs.filter(ascii_lower(F.col("text")).rlike(GATE)).select(
        *keys, F.concat(F.lit(" "), words, F.lit(" ")).alias("norm")
    )
    asked = gated.select(*keys, "norm", F.explode(F.array(*map(F.lit, keywords))).alias("keyword")).filter(
        F.expr("contains(norm, keyword)")
    )
    tried = asked.join(F.broadcast(table), "keyword").filter(F.expr("rlike(norm, pattern)"))  # a few hundred rules
    # What lies between the matches gives the places of these: word by word, spaces are counted.
    cut = tried.select(
        *keys, "label", "rule", "priority", "confidence",
        F.expr(f"transform(split(norm, pattern, -1), x -> {_spaces('x')})").alias("gaps"),
        F.expr(f"transform(regexp_extract_all(norm, pattern, 0), x -> {_spaces('x')})").alias("lengths"),
    )
    placed = cut.select(
        *keys, "label", "rule", "priority", "confidence",
        F.explode(F.expr("""
            aggregate(zip_with(slice(gaps, 1, size(lengths)), lengths, (g, n) -> struct(g, n)),
                struct(0 as at, cast(array() as array<struct<start: int, end: int>>) as found),
                (s, x) -> struct(s.at + x.g + x.n as at,
                                 concat(s.found, array(struct(s.at + x.g as start, s.at + x.g + x.n as end))) as found),
                s -> s.found)
        """)).alias("m"),
    ).select(*keys, "label", "rule", "priority", "confidence", "m.start", "m.end")
    order = (
        Window.partitionBy(*keys).orderBy("start", F.desc("end"), F.desc("priority"), "rule")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    levels = sorted({r.priority for r in rules()})
    covered = reduce(
        lambda rest, level: F.when(
            F.col("priority") == level, F.max(F.when(F.col("priority") >= level, F.col("end"))).over(order) >= F.col("end")
        ).otherwise(rest),
        levels,
        F.lit(False),
    )
    return placed.withColumn("covered", F.coalesce(covered, F.lit(False))).filter("not covered").drop("covered")


def base_places(words: Column) -> dict[str, Column]:
    """Starts of each base phrase, by phrase."""
    none = F.array().cast("array<int>")

    def places(parts: list[str]) -> Column:
        def here(i: Column) -> Column:
            return reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)])

        # Only where the last word occurs at all.
        possible = F.array_contains(words, parts[-1]) & (F.size(words) >= len(parts))
        return F.when(possible, F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)).otherwise(none)

    return {phrase: places(phrase.split(" ")) for phrase in BASE}


def scan(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score and ``found`` (the surviving detections)."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")
    found = detections(keyed, ["doc_id", "_text"]).groupBy("doc_id", "_text").agg(
        F.collect_set("label").alias("more"),
        F.max("confidence").alias("best"),
        F.array_sort(F.collect_set(F.struct("start", "end", "label", "rule"))).alias("found"),
    )
    places = base_places(F.col("words"))
    based = keyed.select("doc_id", "_text", word_list(F.col("text")).alias("words")).select(
        "doc_id", "_text", F.size("words").alias("n_words"), *[p.alias(f"p{i}") for i, p in enumerate(places.values())]
    )
    everywhere = F.concat(*[F.col(f"p{i}") for i in range(len(places))])
    labels = F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(BASE[p])) for i, p in enumerate(places)])
    based = based.select(
        "doc_id", "_text", F.col("n_words").cast("long").alias("n_words"),
        F.size(everywhere).cast("long").alias("n_base"),
        F.array_min(everywhere).cast("long").alias("first_word"),
        F.array_max(everywhere).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(labels)).alias("base"),
    ).alias("d")
    right = found.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"), "more", "best", "found")
    none = F.array().cast("array<string>")
    return based.join(
        right, F.col("d.doc_id").eqNullSafe(F.col("_id")) & (F.col("d._text") == F.col("_hash")), "left"
    ).select(
        "d.doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0))).alias("score"),
        "found",
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License scan of all documents.

    A null or empty text has no words and no labels (empty strings, score 0);
    rows that repeat a doc_id are scanned one by one.
    """
    return scan(documents(spark, sf_dir)).drop("found")
