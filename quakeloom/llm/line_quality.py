"""Line-first cleaning.

Every line is judged by rules on its own: navigation, markup, boilerplate
phrases, missing sentence ends, and repeats of an earlier line. Lines that fail
go; a document that loses too much of its text that way is rejected. Beside the
verdict stand plain measures of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quakeloom.llm.arrow import map_arrow, slices
from quakeloom.llm.tables import documents

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: A word made of separators only, as between the links of a menu.
SEPARATOR = "^[|/>»›•·]+$"
#: A sentence ends somewhere in the line.
SENTENCE_END = "[.!?…。！？]['\")\\]’”»]*(?:[\\x20\\x09-\\x0D]|$)"
#: Phrases of page furniture, in lower case.
PHRASES = (
    "accept all cookies", "accept cookies", "add to cart", "all rights reserved", "back to top", "click here",
    "cookie policy", "cookie settings", "enable javascript", "follow us on", "forgot your password", "javascript is disabled",
    "leave a comment", "log in to", "lorem ipsum", "posted by", "privacy policy", "read more", "sign up for", "share this",
    "skip to content", "skip to main content", "subscribe to our", "terms of service", "terms of use", "uses cookies",
)
#: A longer line with such a phrase is prose about it.
PHRASE_WORDS = 25
#: More than this many symbols in ten words are markup.
MARKUP = 3
#: Share of the characters in words that a kept document may lose, in hundredths.
MAX_LOST = 40
#: Limits of the plain measures.
MIN_WORDS, MAX_REPEATED = 50, 50

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = ("navigation", "markup", "boilerplate", "no_sentence", "repeat")

_word, _symbol, _separator, _end = re.compile(WORD), re.compile(SYMBOLS), re.compile(SEPARATOR), re.compile(SENTENCE_END)
_phrase = re.compile("|".join(map(re.escape, PHRASES)))
_ascii_lower = str.maketrans(UPPER, LOWER)


def failed_rule(line: str, words: list[str], repeat: bool) -> str | None:
    """First rule that a line with words fails."""
    separators = sum(1 for w in words if _separator.match(w))
    if separators >= 2 or separators and len(words) <= 8:
        return "navigation"
    if 10 * len(_symbol.findall(line)) > MARKUP * len(words):
        return "markup"
    if len(words) <= PHRASE_WORDS and _phrase.search(line.translate(_ascii_lower)):
        return "boilerplate"
    if not _end.search(line):
        return "no_sentence"
    return "repeat" if repeat else None


def _repeated_words(words: list[str]) -> int:
    """Words covered by a window of three that occurs twice or more."""
    count = len(words) - 2
    if count < 2:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) < 1 << 21:
        keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    else:
        _, inverse, times = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True, return_counts=True)
    again = (times > 1)[inverse.ravel()]
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + count] |= again
    return int(covered.sum())


def clean(text: str | None) -> dict:
    """Measures of a text, its failed lines by rule, what is left of it, and the verdict.

    A line without words is neither judged nor removed.
    """
    words: list[str] = []
    seen: set[str] = set()
    left, failed = [], dict.fromkeys(RULES, 0)
    lost = repeats = 0
    for line in (text or "").split("\n"):
        own = _word.findall(line)
        if own:
            repeat = line in seen
            seen.add(line)
            repeats += repeat
            words += own
            if rule := failed_rule(line, own, repeat):
                failed[rule] += 1
                lost += sum(map(len, own))
                continue
        left.append(line)
    n, chars, again = len(words), sum(map(len, words)), _repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * again > MAX_REPEATED * n
    return {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": len(_symbol.findall(text or "")),
        "n_dup_lines": repeats,
        "n_repeat_words": again,
        "base_failed": base_failed,
        "kept": not base_failed and 100 * lost <= MAX_LOST * chars,
        "lost_chars": lost,
        "failed": list(failed.values()),
        "cleaned": "\n".join(left),
    }


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "lost_chars long, failed array<int>, cleaned string"
)
TYPES = {"base_failed": pa.bool_(), "kept": pa.bool_(), "failed": pa.list_(pa.int32()), "cleaned": pa.large_string()}


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """doc_id and the fields of ``clean`` for every row of (doc_id, text).

    ``failed`` counts the lines removed by each of RULES; ``cleaned`` is the text
    of the lines left. A null text has no words and no lines left; rows that
    repeat or lack a doc_id are judged one by one; other columns are not read.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                found = [clean(t) for t in batch.column("text").to_pylist()]
                columns = {k: pa.array([f[k] for f in found], TYPES.get(k, pa.int64())) for k in found[0]}
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns.values()], ["doc_id", *columns])

    return map_arrow(docs.select("doc_id", "text"), judge, f"doc_id long, {MEASURES}")


def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for all documents; see ``cleaned_documents``."""
    return cleaned_documents(documents(spark, sf_dir)).drop("failed", "cleaned")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_WORDS_OF = f"regexp_extract_all({{}}, {_quoted(WORD)})"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, {_WORDS_OF.format("text")} AS words FROM d),
lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d
),
split AS (SELECT r, place, line, {_WORDS_OF.format("line")} AS words FROM lines),
judged AS (
  SELECT r, list_sum(list_transform(words, lambda x: length(x))) AS chars, row_number() OVER (PARTITION BY r, line ORDER BY place) > 1 AS again,
    len(words) AS n, len(list_filter(words, lambda x: regexp_matches(x, {_quoted(SEPARATOR)}))) AS separators,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
    regexp_matches(translate(line, '{UPPER}', '{LOWER}'), {_quoted("|".join(PHRASES))}) AS phrase,
    regexp_matches(line, {_quoted(SENTENCE_END)}) AS ends
  FROM split WHERE len(words) > 0
),
lost AS (
  SELECT r, sum(CASE WHEN separators >= 2 OR (separators > 0 AND n <= 8) OR 10 * symbols > {MARKUP} * n
      OR (n <= {PHRASE_WORDS} AND phrase) OR NOT ends OR again THEN chars ELSE 0 END) AS lost,
    count(*) FILTER (WHERE again) AS repeats
  FROM judged GROUP BY r
),
flat AS (SELECT r, generate_subscripts(words, 1) AS i, words FROM w),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) > 1 AS twice FROM flat WHERE i <= len(words) - 2),
covered AS (
  SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM windows WHERE twice) GROUP BY r
),
measured AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(repeats, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost_chars
  FROM w LEFT JOIN lost USING (r) LEFT JOIN covered USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * lost_chars <= {MAX_LOST} * word_chars AS kept,
  CAST(lost_chars AS BIGINT) AS lost_chars
FROM measured
"""
