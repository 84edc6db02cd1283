"""Small awkward tables and brute-force versions, without Spark."""

from __future__ import annotations

import random
import re

CLASHING = [
    "score", "slot", "shard", "block", "part", "extra", "key", "n", "node", "sign", "bands", "label", "words", "place",
    "item_ids", "spans", "offset", "_text", "_row", "_id", "_hash", "_left", "_node", "_source", "_part", "_file", "bucket",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
LETTERS = "abcdefghijklmnop"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 7))) for _ in range(n)]


def awkward_texts() -> list[tuple[int | None, str | None]]:
    """(doc_id, text): nulls, empties, blanks, long ones, copies, near copies, ties and repeated rows."""
    rng = random.Random(5)
    base = words(rng, 60)
    long = words(rng, 30_000)
    near = [" ".join([*base[:40], w, *base[40:]]) for w in words(rng, 20)]
    rows: list[tuple[int | None, str | None]] = [
        (1, " ".join(base)), (2, " ".join(base)), (3, None), (4, ""), (5, " \t\n "), (6, "one two"), (7, "ONE  two"),
        (8, " ".join(long)), (9, " ".join(base[:30]) + "\n" + " ".join(words(rng, 30))), (None, "no id " + " ".join(base[5:40])),
        (None, None), (11, "x"), (11, "x"), (12, " ".join(base[:25])), (12, " ".join(base[20:45])), (-5, "Ünïcode ÉTÉ " + " ".join(base[:20])),
        (14, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a"), (15, "a a a a a a a a a a a a a a a a"),
        (16, "\x00 zero\x00 \x85next a　b"), (17, "İstanbul ẞ ſ K Ⅷ Ⓐ idiot"),
    ]
    rows += [(100 + i, t) for i, t in enumerate(near)]
    return rows


def documents(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    sources = [None, "a", "a", "a", "b", ""]
    return [
        (i, t, None if k % 5 == 0 else "en", sources[k % len(sources)], None if t is None or k % 4 == 0 else len(t), *[f"c{k}"] * len(CLASHING))
        for k, (i, t) in enumerate(rows)
    ]


def write(spark, folder, rows, labels=(), benchmark=()) -> str:
    spark.createDataFrame(documents(rows), SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def shingles(text: str | None) -> set[tuple[str, ...]]:
    w = plain_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0
