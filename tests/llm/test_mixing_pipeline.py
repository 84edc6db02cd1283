from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quakeloom.llm import mixing
from tests.llm import fixtures as fx


def slots_of(spark, shares):
    frame = spark.createDataFrame([(k, 1, q) for k, q in shares.items()], "_source string, total long, q long")
    rows = mixing.schedule(frame).orderBy("turn_slot").collect()
    return [(r["_source"], r["turn"]) for r in rows], rows


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 3, "b": 2}, {"a": 70, "b": 20, "c": 7, "d": 3}, {f"s{i}": i + 1 for i in range(24)}])
def test_no_source_is_a_block_away_from_its_share(spark, shares):
    order, _ = slots_of(spark, shares)
    period, done = sum(shares.values()), Counter()
    assert len(order) == period
    for t, (source, turn) in enumerate(order, 1):
        assert turn == done[source]
        done[source] += 1
        assert all(abs(done[s] - t * q / period) < 1 for s, q in shares.items())
    assert done == shares


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return fx.write(spark, tmp_path_factory.mktemp("a"), fx.awkward_texts(), [(1, 1, 0), (17, 0, 1)], [(1, "no id")])


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return fx.write(spark, tmp_path_factory.mktemp("e"), [])


def test_every_row_is_placed_once(spark, awkward, empty):
    docs = mixing.sized(spark.read.parquet(f"{awkward}/documents.parquet"))
    rows = mixing.mix(docs, block_bytes=500, period=50).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in fx.awkward_texts())
    assert {r["epoch"] for r in rows} == {0}
    assert None in {r["source"] for r in rows} and "" in {r["source"] for r in rows}
    assert mixing.op7_mixing(spark, empty).count() == 0
    assert mixing.op7_mixing(spark, awkward).count() >= len(rows)


def test_repeats_hold_the_weights_to_the_end(spark):
    docs = mixing.sized(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    weights = {"src0": 0.5, "src1": 0.3, "src2": 0.2}
    block = 4096
    rows = mixing.mix(docs, weights, repeat=True, block_bytes=block, period=100).collect()
    assert {r["source"] for r in rows} == set(weights)
    blocks = defaultdict(set)
    for r in rows:
        blocks[r["slot"]].add((r["source"], r["block"]))
    assert all(len(b) == 1 for b in blocks.values())
    last = max(blocks)
    for s, w in weights.items():
        mine = [r for r in rows if r["source"] == s]
        assert abs(max(r["block"] for r in mine) + 1 - w * (last + 1)) <= 10 + 33047 / block
        # Every document comes in each epoch but perhaps the last.
        assert len({r["doc_id"] for r in mine if r["epoch"] == 0}) == 50
    total = Counter()
    for r in rows:
        total[r["source"]] += r["size"]
    whole = sum(total.values())
    assert all(abs(total[s] / whole - w) < 0.03 for s, w in weights.items())


def test_a_source_that_runs_out_leaves_the_others_in_order(spark):
    frame = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 900, "big").otherwise("small").alias("source"), F.lit(100).cast("long").alias("size"), F.lit(1).cast("long").alias("_text"))
    rows = sorted(mixing.mix(frame, {"big": 0.5, "small": 0.5}, block_bytes=100, period=10).collect(), key=lambda r: (r["slot"], r["offset"]))
    count = Counter()
    for t, r in enumerate(rows[:200], 1):
        count[r["source"]] += 1
        assert abs(count["small"] - t / 2) < 1
    assert {r["source"] for r in rows[200:]} == {"big"} and len(rows) == 1000


def test_mixed_documents_keep_rows_and_columns(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    mixed = mixing.mixed_documents(docs, block_bytes=500, period=50)
    assert mixed.columns == docs.columns
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, docs.collect()))


def test_pipeline_stages_on_awkward_rows(spark, awkward, empty):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, awkward).columns == docs.columns
    assert corpus_pipeline.run(spark, awkward).columns[:2] == ["doc_id", "start"]
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_by_brute_force(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    frames = {"documents": spark.read.parquet(f"{folder}/documents.parquet")}
    docs = frames["documents"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = frames[name] = spark.read.parquet(str(tmp_path / name))
    rows = {k: {r["doc_id"]: r["text"] for r in v.select("doc_id", "text").collect()} for k, v in frames.items()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    gone = rows["documents"].keys() - rows["toxicity"].keys()
    toxic = {i for i, t in labels.items() if t == 1}
    # Fifty toxic examples in four languages are few; clean documents must stay nevertheless.
    assert len(toxic - gone) <= 0.3 * len(toxic) and sum(labels.get(i) == 0 for i in gone) <= 0.01 * len(labels)
    # One document of each group of near-equal ones stays.
    before = rows["toxicity"]
    sets = {i: fx.shingles(t) for i, t in before.items()}
    leader = dict.fromkeys(before)
    names = {i: i for i in before}

    def find(i):
        while names[i] != i:
            i = names[i]
        return i

    by_gram = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by_gram[g].append(i)
    pairs = Counter((a, b) for ids in by_gram.values() if len(ids) < 200 for a in ids for b in ids if a < b)
    for a, b in pairs:
        if fx.jaccard(sets[a], sets[b]) >= 0.8:
            a, b = sorted((find(a), find(b)))
            names[b] = a
    leader = {find(i) for i in before}
    assert rows["near_duplicates"].keys() == leader
    from tests.llm.test_filters import brute_hits

    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    grams = {" ".join(w[i : i + 10]) for _, t in items for w in [fx.lowered_words(t)] for i in range(max(1, len(w) - 9))}
    dirty = {i for i, t in rows["near_duplicates"].items() if any(" ".join(w[k : k + 10]) in grams for w in [fx.lowered_words(t)] for k in range(len(w) - 9))}
    assert dirty and all(brute_hits(rows["near_duplicates"][i], items)[1] for i in list(dirty)[:5])
    assert rows["decontamination"].keys() == rows["near_duplicates"].keys() - dirty
    assert rows["mixing"] == rows["decontamination"]
    # The last stage follows the mix.
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).orderBy("start").collect()
    mixed = mixing.mix(mixing.sized(frames["decontamination"])).orderBy("slot", "offset").collect()
    assert [r["doc_id"] for r in last] == [r["doc_id"] for r in mixed]


@pytest.mark.parametrize("totals", [{"hot": 10_000_000} | {f"s{i:02d}": 1_000_000 for i in range(19)}, {"hot": 3_000_000} | {f"s{i:04d}": 3000 + i for i in range(2000)}])
def test_no_source_is_a_block_away_from_its_weight(spark, totals):
    sizes = spark.createDataFrame(list(totals.items()), "_source string, total long")
    rows = mixing.schedule(mixing.shares(sizes, None, mixing.PERIOD), 1000, repeat=True).orderBy("turn_slot").collect()
    weight = {s: n**mixing.TEMPER for s, n in totals.items()}
    whole, done = sum(weight.values()), Counter()
    last = max(-(-n // 1000) * whole / weight[s] for s, n in totals.items())
    for t, r in enumerate(rows[: int(last)], 1):
        assert r["turn_slot"] == t - 1 and r["turn"] == done[r["_source"]]
        done[r["_source"]] += 1
        for s in ("hot", r["_source"]) if t % 500 else weight:
            assert abs(done[s] - t * weight[s] / whole) < 1 + 1e-6
    assert len(rows) >= int(last) and all(done[s] >= -(-n // 1000) - 1 for s, n in totals.items())
