from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeloom.llm import bottom_k, jaccard_join, repeats
from tests.llm import fixtures as fx


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return fx.write(spark, tmp_path_factory.mktemp("a"), fx.awkward_texts())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return fx.write(spark, tmp_path_factory.mktemp("e"), [])


def without_repeats(rows, length=13):
    low = -(1 << 63)
    first = {}
    for i, t in rows:
        w = fx.plain_words(t)
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            first[g] = min(first.get(g, low if i is None else i), low if i is None else i)
    for i, t in rows:
        w = fx.plain_words(t)
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < (low if i is None else i):
                gone.update(range(k, k + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        yield i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("bucket_bytes", [1 << 21, 2000])
def test_repeats_of_awkward_rows(spark, awkward, bucket_bytes):
    docs = spark.read.parquet(f"{awkward}/documents.parquet").select("doc_id", "text")
    rows = repeats.remove_repeats(docs, bucket_bytes=bucket_bytes).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256), "removed").collect()
    assert Counter(tuple(r)[:4] for r in rows) == Counter(without_repeats(fx.awkward_texts()))
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]
        assert all(s["end"] - s["start"] >= 13 for s in r["removed"])


def test_repeats_of_an_empty_table(spark, empty):
    assert repeats.op3_repeats(spark, empty).count() == 0


def test_sketches_estimate_sets():
    import pyarrow as pa

    rng = fx.random.Random(1)
    w = fx.words(rng, 4000)
    a, b = " ".join(w[:3000]), " ".join(w[1000:])
    x, y = bottom_k.sketches(pa.array([a, b]))
    exact = fx.jaccard(fx.shingles(a), fx.shingles(b))
    assert abs(bottom_k.resemblance(x, y) - exact) < 0.15
    assert abs(bottom_k.containment(x, y) - 2 / 3) < 0.2
    assert abs(bottom_k.distinct(x) / len(fx.shingles(a)) - 1) < 0.3
    whole = bottom_k.sketches(pa.array([" ".join(w)]))[0]
    parts = bottom_k.merge(x, y)
    assert parts.tolist() == bottom_k.sketches(pa.array([" ".join(w)]))[0].tolist() == whole.tolist()
    assert bottom_k.from_text(bottom_k.to_text(x)).tolist() == x.tolist()


def test_small_sets_are_exact():
    import pyarrow as pa

    rng = fx.random.Random(2)
    texts = [" ".join(fx.words(rng, 12)[:n]) for n in (0, 1, 3, 5, 9, 12)] + ["a a a a a a a a"]
    texts += [t + " more words here" for t in texts]
    found = bottom_k.sketches(pa.array(texts))
    for s, t in zip(found, texts, strict=True):
        assert bottom_k.distinct(s) == len(fx.shingles(t))
        for r, u in zip(found, texts, strict=True):
            assert bottom_k.resemblance(s, r) == pytest.approx(fx.jaccard(fx.shingles(t), fx.shingles(u)))


def test_merged_fingerprints_of_groups(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    prints = bottom_k.fingerprints(docs).filter("doc_id > 0").withColumn("g", F.col("doc_id") % 2)
    rows = {r["g"]: r for r in bottom_k.merged(prints, ["g"]).collect()}
    for g in (0, 1):
        union = set().union(*[fx.shingles(t) for i, t in fx.awkward_texts() if i and i > 0 and i % 2 == g])
        assert abs(rows[g]["n_shingles"] / len(union) - 1) < 0.3


@pytest.mark.parametrize("part_bytes", [1 << 24, 3000])
def test_edited_fingerprints(spark, awkward, part_bytes):
    docs = spark.read.parquet(f"{awkward}/documents.parquet").select("doc_id", "text")
    placed = bottom_k.with_next(docs, part_bytes)
    rows = bottom_k.map_arrow(
        placed, bottom_k._compare,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double, n_shingles double, contained_in_edited double",
    ).collect()
    hashes = dict(spark.createDataFrame([(t,) for _, t in fx.awkward_texts()], "t string").select("t", F.xxhash64("t")).collect())
    ordered = sorted(fx.awkward_texts(), key=lambda r: (-(1 << 63) if r[0] is None else r[0], hashes[r[1]]), reverse=True)
    want = Counter()
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
        mine = [r for r in rows if r["doc_id"] == i and r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()]
        assert mine and abs(mine[0]["near_edited"] - fx.jaccard(fx.shingles(t), fx.shingles(edited))) < 0.15
        assert any(abs(r["near_next"] - fx.jaccard(fx.shingles(t), fx.shingles(after))) < 0.15 for r in mine)
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    prints = defaultdict(set)
    for r in rows:
        prints[r["n_chars"]].add(r["fingerprint"])
    assert len(prints[1]) == 1


def test_fingerprints_of_one_document_and_none(spark, empty, tmp_path):
    assert bottom_k.op6_bottom_k(spark, empty).count() == 0
    alone = fx.write(spark, tmp_path, [(1, "abcdef")])
    row = bottom_k.op6_bottom_k(spark, alone).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and row["near_next"] == 1.0


def brute_classes(rows):
    texts = {}
    for i, t in rows:
        if t is not None:
            texts[t] = min(texts.get(t, 1 << 62), -(1 << 63) if i is None else i)
    sets = {t: fx.shingles(t) for t in texts}
    links = {t: {u for u in texts if u != t and sets[t] and sets[u] and 5 * len(sets[t] & sets[u]) >= 4 * len(sets[t] | sets[u])} for t in texts}
    least = dict(texts)
    for _ in texts:
        least = {t: min([least[t], *[least[u] for u in links[t]]]) for t in texts}
    show = lambda x: None if x == -(1 << 63) else x
    for i, t in rows:
        yield (i, i, i, 0) if t is None else (i, show(least[t]), show(texts[t]), len(links[t]))


@pytest.mark.parametrize(("small", "block"), [(16, 512), (4, 6), (1, 512)])
def test_jaccard_join_of_awkward_rows(spark, awkward, monkeypatch, small, block):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = jaccard_join.op10_jaccard_join(spark, awkward).select("doc_id", "class_id", "copy_of", "n_links").collect()
    assert Counter(map(tuple, rows)) == Counter(brute_classes(fx.awkward_texts()))


def test_one_of_each_group_stays(spark, awkward, empty):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {(i, t) for (i, t), c in zip(fx.awkward_texts(), brute_classes(fx.awkward_texts()), strict=True) if t is None or i == c[1] == c[2]}
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    # One row for a repeated row; null texts all stay; of texts with one doc_id the one that leads its class.
    assert set(got) <= want and {i for i, _ in got} == {i for i, _ in want} and len(got) == len(set(got))
    assert jaccard_join.op10_jaccard_join(spark, empty).count() == 0
    assert jaccard_join.one_of_each(spark.read.parquet(f"{empty}/documents.parquet")).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    steps = jaccard_join.needed_matches()
    assert steps[-1][0] == jaccard_join.BANDS * jaccard_join.ROWS
    rng = np.random.default_rng(3)
    for share, low, high in ((0.8, 0.999, 1.0), (0.5, 0.0, 0.01)):
        same = rng.random((4000, steps[-1][0])) < share
        a = np.zeros(same.shape, np.uint8)
        b = np.where(same, 0, 1).astype(np.uint8)
        rows = np.arange(4000)
        assert low <= len(jaccard_join._survivors(a, b, rows, rows, steps)) / 4000 <= high


def test_every_class_keeps_one_document(spark, awkward, tmp_path):
    def classes(rows):
        texts = sorted({t for _, t in rows if t is not None})
        sets, names = {t: fx.shingles(t) for t in texts}, {t: t for t in texts}
        for t in texts:
            for u in texts:
                if sets[t] and sets[u] and 5 * len(sets[t] & sets[u]) >= 4 * len(sets[t] | sets[u]):
                    old, new = names[u], names[t]
                    names = {k: new if v == old else v for k, v in names.items()}
        return names

    alpha, beta, gamma = (" ".join(f"{c}{k}" for k in range(30)) for c in "abc")
    # Unrelated texts of one doc_id or none, each at the head of copies of its own.
    rows = [(None, alpha), (None, beta), (None, gamma), (7, alpha + " x"), (8, beta + " x"), (9, gamma), (3, "one two"), (3, "three four"), (4, "three four")]
    for folder, table in ((awkward, fx.awkward_texts()), (fx.write(spark, tmp_path, rows), rows)):
        names = classes(table)
        kept = Counter(names[r["text"]] for r in jaccard_join.one_of_each(spark.read.parquet(f"{folder}/documents.parquet")).collect() if r["text"] is not None)
        assert kept == Counter(set(names.values()))
