from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from quakeloom.llm import line_quality, spelling, whitening
from tests.llm import fixtures

INF = float("inf")


# -- whitening -------------------------------------------------------------------------------------


def vectors(spark, folder, rows) -> str:
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, _v int").repartition(3).write.parquet(
        f"{folder}/embeddings.parquet"
    )
    return str(folder)


def whitened_by_hand(rows):
    """numpy on the distinct quantised vectors."""
    good = [(i, [math.floor(256 * c) for c in v]) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit - np.array([s / n for s in sums], dtype=object)).astype(float)
    cov = centred.T @ centred / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:4], vecs[:, ::-1][:, :4]
    out = {}
    for i, x in good:
        off = n * np.array(x, dtype=object) - sums
        z = (off / n).astype(float) @ vecs / np.sqrt(values)
        for k in range(len(values)):
            out.setdefault((i, k + 1), []).append((n, int((off * off).sum()), abs(z[k]), values[k] / np.trace(cov)))
    return out


def test_whitening_equals_an_exact_covariance(spark, tmp_path):
    rng = np.random.default_rng(3)
    draws = (rng.standard_normal((300, 6)) * [3, 2, 1.5, 1, 0.5, 0.2]).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0, "a", 1) for i, v in enumerate(draws)]
    rows += [(7, rows[7][1], 1, None, None), (400, rows[8][1], 1, "b", 2), (None, rows[9][1], None, "b", 2)]  # repeats, no id
    bad = [None, [], [None] * 6, [INF] + [0.0] * 5, [float("nan")] * 6, [1.0] * 5]
    sf = vectors(spark, tmp_path, rows + [(900 + k, v, 0, "c", 3) for k, v in enumerate(bad)])
    got = whitening.op11_whitening(spark, sf).collect()
    want = whitened_by_hand(rows)
    assert len(got) == sum(map(len, want.values())) == 303 * 4
    sign = {}
    for r in got:
        n, deviation, size, explained = want[(r.vec_id, r.component)][0]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - size) < 1e-9 and abs(r.explained - explained) < 1e-12 and r.identity_error < 1e-12
        sign.setdefault((r.vec_id, r.component), set()).add(r.whitened)
    assert all(len(v) == 1 for v in sign.values())
    again = whitening.op11_whitening(spark, vectors(spark, tmp_path / "shuffled", random.Random(1).sample(rows, len(rows)))).collect()
    # Covariance and components are the same to the last bit, whatever the order of rows.
    exact = [sorted((str(r.vec_id), r.component, r.deviation, r.explained, round(r.whitened, 12)) for r in x) for x in (got, again)]
    assert exact[0] == exact[1]


def test_whitening_of_degenerate_tables(spark, tmp_path):
    def run(name, rows):
        return whitening.op11_whitening(spark, vectors(spark, tmp_path / name, [(i, v, 0, "", 0) for i, v in enumerate(rows)])).collect()

    assert run("none", []) == []
    one = run("one", [[1.0, 2.0]] * 3)
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained) for r in one} == {(1, 0, None, None)}
    line = run("line", [[1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [3.0, 6.0, 9.0]])
    assert [r.whitened is None for r in sorted(line, key=lambda r: r.component)] == [False] * 3 + [True] * 6
    large = run("large", [[3e38, 1.0], [-3e38, 2.0], [1e12, 3.0]])
    assert len(large) == 6 and all(r.deviation is None or r.deviation >= 0 for r in large)
    tied = run("tied", [[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]])
    assert {round(r.explained, 9) for r in tied} == {0.5} and max(r.identity_error for r in tied) < 1e-12


@pytest.mark.parametrize("seed", range(6))
def test_pairs_of_intervals(seed):
    rng = np.random.default_rng(seed)
    basis, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    spectrum = np.sort(np.concatenate([[5.0, 5.0, 4.0, 4.0 - 1e-6], rng.random(26)]))[::-1] * 10.0 ** rng.integers(-20, 20)
    matrix = basis @ np.diag(spectrum) @ basis.T
    matrix = (matrix + matrix.T) / 2
    for shift in (0.3, 0.8, 3.0, 4.5):
        assert whitening.count_above(matrix, shift * spectrum[0] / 5) == (spectrum > shift * spectrum[0] / 5).sum()
    values, vecs = whitening.leading_pairs(matrix, 4)
    assert np.allclose(values, spectrum[:4], rtol=1e-12)
    assert np.abs(matrix @ vecs - vecs * values).max() < 1e-13 * spectrum[0]
    assert np.abs(vecs.T @ vecs - np.eye(4)).max() < 1e-13


# -- lines -------------------------------------------------------------------------------------------


def lines_by_hand(text):
    w = fixtures.plain_words(text)
    lines = [l for l in (text or "").split("\n") if fixtures.plain_words(l)]
    times = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if times[tuple(w[i : i + 3])] > 1}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_lines_equal_plain_counts(spark, tmp_path):
    rows = fixtures.awkward_texts() + [(200, "a b c\n" * 30 + "x | y <&>"), (201, "|"), (202, "\n\n \n")]
    got = line_quality.op12_line_quality(spark, fixtures.write(spark, tmp_path, rows)).collect()
    base = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert base == Counter((i, *lines_by_hand(t)) for i, t in rows)
    assert not any(r.kept and r.base_failed for r in got)
    assert line_quality.op12_line_quality(spark, fixtures.write(spark, tmp_path / "none", [])).collect() == []


PROSE = "The river ran past the old mill, and nobody had mended its wheel for years. "


def prose(n):
    rng = random.Random(n)
    return "\n".join(" ".join(fixtures.words(rng, 12)).capitalize() + "." for _ in range(n))


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("Home | News | Sport | Contact", "navigation"),
        ("Start > Products > Shoes", "navigation"),
        ("« back | next »", "navigation"),
        ("It%%% was*** not### to$$$ be&&& read.", "markup"),
        ("Click here to see the rest.", "boilerplate"),
        ("© 2020 Someone. All Rights Reserved.", "boilerplate"),
        ("Opening hours and prices", "no_sentence"),
        (PROSE, None),
        ("He asked: \"Is it 5% or 6%?\"", None),
        ("A first sentence ends. A second one is cut", None),
        ("今日は晴れです。", None),
        ("The court read the privacy policy of the firm aloud, word by word, for an hour, until everyone in the room had lost the thread of it and slept.", None),
    ],
)
def test_rules_of_lines(line, rule):
    assert line_quality.failed_rule(line, fixtures.plain_words(line), False) == rule
    assert line_quality.failed_rule(line, fixtures.plain_words(line), True) == (rule or "repeat")


def test_verdict_follows_what_is_lost(spark):
    menu = "\n".join(f"Home | Page {k} | Next" for k in range(8))
    clean, mixed, lost = prose(10), prose(10) + "\n" + menu, prose(5) + "\n" + menu * 12
    docs = spark.createDataFrame([(1, clean), (2, mixed), (3, lost), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_quality.cleaned_documents(docs).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[2].cleaned == clean and got[2].failed[0] == 8 and got[1].cleaned == clean and got[4].cleaned == ""


# -- spelling ----------------------------------------------------------------------------------------


def vocabulary_by_hand(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(fixtures.ASCII)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(vocabulary):
    out, forms = {}, {}
    for w, n in vocabulary.items():
        others = [(-m, u) for u, m in vocabulary.items() if near(w, u)]
        best = min(others) if others and -min(others)[0] >= 5 * n else None
        forms[w] = best and best[1]
        out[w] = [n, len(others), best and best[1], best and -best[0]]
    for w in out:
        root = w
        while forms[root]:
            root = forms[root]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def as_rows(frame):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in frame.collect()}


def test_near_words_of_all_kinds(spark):
    rng = random.Random(9)
    words = {"aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "ababab", "bababa", "abcdef", "bcdef", "abcdefg", "éàüßöñ", "éàüßön", "xabcdef", "a", "ab", "b", "ba"}
    words |= {"q" * 60, "q" * 61, "q" * 30 + "r" + "q" * 29, "p" * 55 + "q" * 60, "p" * 55 + "q" * 59, "z" * 20_000}
    for _ in range(400):
        word = "".join(rng.choice("abé") for _ in range(rng.randint(1, 9)))
        words |= {word, word[:3] + rng.choice("abc") + word[3:]}
    counts = {w: 5 ** rng.randint(1, 6) + rng.randint(0, 3) for w in sorted(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert as_rows(spelling.spelling_variants(frame)) == variants_by_hand(counts)


def test_spelling_of_documents(spark, tmp_path):
    rng = random.Random(2)
    known = fixtures.words(rng, 40) + ["hundreds", "hundred", "Hundrets", "École", "écoles", "écolés", "ÉCOLES"]
    rows = fixtures.awkward_texts() + [(300 + k, " ".join(rng.choices(known, [1 / (j + 1) for j in range(len(known))], k=400)).replace(" a", "-a")) for k in range(12)]
    rows += [rows[-1], (None, "hundreds " * 30), (5, "x" * 50_000)] + [(6, "y" * 30_000)] * 5
    sf = fixtures.write(spark, tmp_path, rows)
    got = as_rows(spelling.op13_spelling(spark, sf))
    assert got == variants_by_hand(vocabulary_by_hand(rows)) and any(v[2] for v in got.values())
    con = duckdb.connect()
    few = [(i, t) for i, t in rows if len(t or "") < 5000]
    sf = fixtures.write(spark, tmp_path / "few", few)
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, text FROM '{sf}/documents.parquet/*.parquet'")
    got = spelling.op13_spelling(spark, sf)
    want = con.execute(spelling.ORACLE_SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in got.collect())
    assert spelling.op13_spelling(spark, fixtures.write(spark, tmp_path / "none", [])).collect() == []
