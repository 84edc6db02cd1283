from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quakeloom.llm import histogram_shards as shards
from quakeloom.llm import token_files as tokens
from tests.llm import fixtures as fx

PATH = tokens._tokenizer_path(tokens.TOKENIZER)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return fx.write(spark, tmp_path_factory.mktemp("a"), fx.awkward_texts())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return fx.write(spark, tmp_path_factory.mktemp("e"), [])


def check_shards(rows, count):
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < count
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_awkward_rows(spark, awkward, empty):
    rows = shards.op1_histogram_shards(spark, awkward).collect()
    texts = fx.awkward_texts()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, size(t), zlib.crc32((t or "").encode())) for i, t in texts
    )
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    check_shards(rows, 40)
    assert shards.op1_histogram_shards(spark, empty).count() == 0


def test_shards_are_near_equal_and_keep_equal_texts_together(spark):
    rows = shards.op1_histogram_shards(spark, "/root/testdata/sf0.1").collect()
    total = Counter()
    for r in rows:
        total[r["shard"]] += r["size"]
    mean, largest = sum(total.values()) / 40, max(r["size"] for r in rows)
    assert len(rows) == 10_000 and len(total) == 40
    assert all(abs(v - mean) <= 0.01 * mean + largest for v in total.values())
    check_shards(rows, 40)
    texts = defaultdict(set)
    for r in rows:
        texts[r["text_crc32"], r["size"]].add(r["shard"])
    split = sum(len(s) > 1 for s in texts.values())
    assert split <= 39


def test_a_hot_key_is_split_and_slots_go_on_over_parts(spark):
    # A third of all rows have one first key; parts are smaller than shards.
    frame = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.xxhash64("id")).alias("a"), F.col("id").alias("b"), (F.col("id") % 50 + 1).alias("size")
    )
    out = shards.shard_by_bytes(frame, "a", "b", "size", shards=8, part_bytes=20_000, probes=64).collect()
    total = Counter()
    for r in out:
        total[r["shard"]] += r["size"]
    mean = sum(total.values()) / 8
    assert all(abs(v - mean) <= 0.02 * mean for v in total.values())
    check_shards(out, 8)
    ordered = sorted(out, key=lambda r: (r["a"], r["b"]))
    assert [(r["shard"], r["slot"]) for r in ordered] == sorted((r["shard"], r["slot"]) for r in out)


def test_rows_that_repeat_a_key_stay_together(spark):
    frame = spark.range(1000).select(F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b"), F.lit(5).cast("long").alias("size"))
    out = shards.shard_by_bytes(frame, "a", "b", "size", shards=4).collect()
    assert len({r["shard"] for r in out}) == 1
    check_shards(out, 4)


@given(st.lists(st.integers(0, 5000), max_size=300))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(gaps):
    values = np.cumsum(np.array(gaps, np.int64)) if gaps else np.empty(0, np.int64)
    coded = tokens.EliasFano.encode(values)
    assert coded.decode().tolist() == values.tolist()
    assert [coded.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1000, 50_000))
    assert tokens.EliasFano.encode(values).nbytes * 8 / 50_000 < 2 + np.log2(values[-1] / 50_000) + 1


@given(st.lists(st.text(alphabet=" \n\t\x85\x1cab1'.<|>sé世\x00　 ", max_size=40), min_size=1, max_size=20))
@settings(max_examples=80, deadline=None)
def test_pieces_encode_as_whole_texts(texts):
    ids, counts = tokens.encode_texts(pa.array(texts), PATH)
    whole = [e.ids for e in tokens._tokenizer(PATH).encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for w in whole for i in w] and counts.tolist() == [len(w) for w in whole]


def expected_tokens(ordered):
    start, out = 0, []
    for i, t in ordered:
        ids = tokens._tokenizer(PATH).encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_names_of_added_tokens_encode_as_the_library_does():
    name = "<|endoftext|>"
    texts = ["a %s b", "%s", " %s %s", "a  %s  b c", "x%sy z", "one two\n%s\n three", "%s%s", "<|endof text|> a b", "end %s"] * 3
    texts = [t.replace("%s", name) for t in texts] + ["plain words here", None, " a b " + name, "again b c", "   ", name + " a b"]
    ids, counts = tokens.encode_texts(pa.array(texts), PATH)
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert 50256 in ids


def test_token_files_of_awkward_rows(spark, awkward, empty):
    rows = [tuple(r) for r in tokens.op2_token_files(spark, awkward).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    hashes = dict(spark.createDataFrame([(t,) for _, t in fx.awkward_texts()], "t string").select("t", F.xxhash64("t")).collect())
    low = -(1 << 62)
    ordered = sorted(fx.awkward_texts(), key=lambda r: (r[0] is not None, r[0] or low, hashes[r[1]]))
    # Ids sort as numbers; only the missing one comes first.
    ordered = sorted(ordered, key=lambda r: -(1 << 62) if r[0] is None else r[0])
    assert sorted(rows, key=lambda r: r[1]) == expected_tokens(ordered)
    assert tokens.op2_token_files(spark, empty).count() == 0


def test_token_files_of_documents(spark):
    folder = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    rows = [tuple(r) for r in tokens.op2_token_files(spark, folder).orderBy("start").collect()]
    assert rows == expected_tokens([tuple(r) for r in texts])


def test_small_segments_and_wide_ids(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    tokens.write_token_files(docs, str(tmp_path / "t"), ["doc_id"], end_id=70_000, segment_ids=500, parts=3)
    back = tokens.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == list(range(200))
    assert [r["start"] for r in back] == np.cumsum([0] + [r["n_tokens"] for r in back[:-1]]).tolist()
    segment = spark.read.parquet(str(tmp_path / "t")).orderBy("part", "seq").first()
    assert segment["width"] == 4 and tokens.boundaries(segment.asDict()).select(0) == back[0]["n_tokens"]


def test_file_order_is_kept(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.repartitionByRange(5, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")).write.parquet(str(tmp_path / "d"))
    back = tokens.in_file_order(spark.read.parquet(str(tmp_path / "d"))).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == list(range(199, -1, -1))
    loose = tokens.in_file_order(spark.createDataFrame([(2, "b"), (1, None)], "doc_id long, text string"))
    assert [r["doc_id"] for r in loose.orderBy("start").collect()] == [1, 2]
