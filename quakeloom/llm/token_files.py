"""Token files: concatenated ids with Elias-Fano document boundaries.

Documents are range-partitioned in the wanted order; each task encodes its
part and appends segments to one Parquet file, which Spark commits, so a lost
executor costs that part only. A segment is one row:

* ``part``, ``seq``: place in the whole; ``base``: ids of the part before it;
* ``doc_ids``: documents in order;
* ``ids``: the ids of all its documents, little-endian, ``width`` bytes each;
* ``n_ids``, ``low_bits``, ``low``, ``high``, ``samples``: the documents' ends
  as an Elias-Fano sequence, about 2 + log2(ids per document) bits each. Low
  bits are packed; high parts are unary; every 64th one is sampled, so that
  ``select`` scans a few bytes.

The start of a document in the whole is the part's start (one sum per part),
plus ``base``, plus its predecessor's end.
"""

from __future__ import annotations

import itertools
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeloom.llm.arrow import map_arrow, slices
from quakeloom.llm.tables import documents
from quakeloom.session import checkpoint_dir

END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
SAMPLE = 64
SEGMENT_IDS = 1 << 20
SLICE_BYTES = 4 << 20
#: Pieces that are encoded as one string.
JOINED = 512
#: Where a space before another character stands, a new pre-token begins whatever came before.
WHITE = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CUT = "\x00"


@dataclass
class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space."""

    count: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @staticmethod
    def encode(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        count, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // count).bit_length() - 1) if count else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(count)
        bits = np.zeros(int(ones[-1]) + 1 if count else 0, np.uint8)
        bits[ones] = 1
        return EliasFano(count, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def _low(self, first: int, last: int) -> np.ndarray:
        begin, end = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :][: end - begin]
        weights = np.left_shift(np.uint64(1), np.arange(self.low_bits, dtype=np.uint64))
        return (bits.reshape(last - first, self.low_bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The ``i``-th value, read from the bytes around it."""
        at, rest = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        ones = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        ones[: at % 8] = 0
        while rest >= (here := int(ones.sum())):
            rest, byte = rest - here, byte + 1
            ones = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        position = byte * 8 + int(np.flatnonzero(ones)[rest])
        return ((position - i) << self.low_bits) | int(self._low(i, i + 1)[0])

    def decode(self) -> np.ndarray:
        """All values: select of every index at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        high = (ones - np.arange(self.count)).astype(np.uint64)
        return ((high << np.uint64(self.low_bits)) | self._low(0, self.count)).astype(np.int64)

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes


@cache
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _added_pattern(path: str) -> str | None:
    """Finds the names of added tokens, which the library takes for these tokens in any text."""
    names = [re.escape(t.content) for t in _tokenizer(path).get_added_tokens_decoder().values()]
    return "|".join(names) or None


def _has_added(texts: pa.Array, path: str) -> pa.Array:
    pattern = _added_pattern(path)
    return pc.match_substring_regex(texts, pattern) if pattern else pa.array(np.zeros(len(texts), bool))


@cache
def _byte_lengths(path: str) -> np.ndarray:
    """Bytes of text behind each id; the vocabulary spells a byte as one character."""
    vocabulary = _tokenizer(path).get_vocab()
    lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
    lengths[list(vocabulary.values())] = list(map(len, vocabulary))
    return lengths


def _tokenizer_path(name: str) -> str:
    return name if os.sep in name else public_tokenizers.path(name)


def _flat(encoded: list) -> tuple[np.ndarray, np.ndarray]:
    ids = [e.ids for e in encoded]
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths


def _encode_pieces(pieces: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after the other, and how many each has.

    Pieces that begin with a space keep to themselves wherever they stand, so
    many are encoded as one string, and the bytes behind the ids tell them apart.
    """
    tokenizer = _tokenizer(path)
    spaced = pc.and_not(pc.starts_with(pieces, " "), _has_added(pieces, path)).to_numpy(zero_copy_only=False)
    alone, alone_lengths = _flat(
        tokenizer.encode_batch_fast(pieces.filter(pa.array(~spaced)).to_pylist(), add_special_tokens=False)
    )
    inner = pieces.filter(pa.array(spaced))
    listed = inner.to_pylist()
    strings = ["".join(listed[i : i + JOINED]) for i in range(0, len(listed), JOINED)]
    ids, _ = _flat(tokenizer.encode_batch_fast(strings, add_special_tokens=False))
    piece_ends = np.cumsum(pc.binary_length(inner).to_numpy(zero_copy_only=False).astype(np.int64))
    last = np.searchsorted(np.cumsum(_byte_lengths(path)[ids]), piece_ends)
    lengths = np.empty(len(pieces), np.int64)
    lengths[~spaced] = alone_lengths
    lengths[spaced] = np.diff(last + 1, prepend=0)
    out = np.empty(int(lengths.sum()), np.uint32)
    mine = np.repeat(spaced, lengths)
    out[mine], out[~mine] = ids, alone
    return out, lengths


class _Known:
    """Pieces that this worker has encoded: at most about ``limit``, or ``limit_bytes`` of text, then it starts anew."""

    limit, limit_bytes = 1 << 19, 1 << 25

    def __init__(self, path: str) -> None:
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.pieces = pa.array([], pa.string())
        self.ids, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64)

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Where each piece is among the known ones, after adding those that are new."""
        if len(self.pieces) > self.limit or self.pieces.nbytes > self.limit_bytes:
            self.clear()
        place = pc.index_in(pieces, value_set=self.pieces)
        fresh = pc.is_null(place)
        new = pieces.filter(fresh)
        ids, lengths = _encode_pieces(new, self.path)
        out = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        out[fresh.to_numpy(zero_copy_only=False)] = len(self.pieces) + np.arange(len(new))
        self.pieces = pa.concat_arrays([self.pieces, new])
        self.ids = np.concatenate([self.ids, ids])
        self.lengths = np.concatenate([self.lengths, lengths])
        return out


_known = cache(_Known)


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and how many each has.

    A text is cut before each space that a visible character follows, where a
    byte-level pre-token always begins; each different piece is encoded once. One
    with the name of an added token (an end of text, say) stays whole, as the
    library splits it there first.
    """
    texts = texts.fill_null("").cast(pa.string())
    marked = pc.or_(pc.match_substring(texts, CUT), _has_added(texts, path))
    cut = pc.if_else(marked, texts, pc.replace_substring_regex(texts, f" ([^{WHITE}])", CUT + r" \1"))
    pieces = pc.split_pattern(cut, CUT)
    if pc.any(marked).as_py():  # such a text stays whole, like one with the mark itself
        whole = marked.to_pylist()
        kept = zip(texts.to_pylist(), whole, pieces.to_pylist(), strict=True)
        pieces = pa.array([[t] if w else p for t, w, p in kept], pa.list_(pa.string()))
    coded = pieces.flatten().dictionary_encode()
    known = _known(path)
    codes = known.places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    flat, lengths = known.ids, known.lengths
    each = lengths[codes]
    ends = np.concatenate(([0], np.cumsum(each)))
    starts = (np.cumsum(lengths) - lengths)[codes]
    ids = flat[np.repeat(starts - ends[:-1], each) + np.arange(ends[-1])]
    borders = np.asarray(pieces.offsets)
    return ids, np.diff(ends[borders - borders[0]])


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(counts + 1)
    out = np.full(int(ends[-1]), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False
    out[keep] = ids
    return out, ends


SEGMENT = (
    "part int, seq int, base long, doc_ids array<long>, width int, ids binary, n_ids long, "
    "low_bits int, low binary, high binary, samples binary"
)


def _encoder(path: str, end_id: int, segment_ids: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = _tokenizer_path(path)
        width = 2 if max(len(_byte_lengths(file)), end_id + 1) <= 1 << 16 else 4
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        waiting: list[tuple[np.ndarray, np.ndarray, list]] = []
        size = 0

        def segment() -> pa.RecordBatch:
            nonlocal seq, base
            ids = np.concatenate([w[0] for w in waiting])
            counts = np.concatenate([w[1] for w in waiting])
            coded = EliasFano.encode(np.cumsum(counts))
            row = {
                "part": part, "seq": seq, "base": base,
                "doc_ids": list(itertools.chain.from_iterable(w[2] for w in waiting)),
                "width": width, "ids": ids.astype(f"<u{width}").tobytes(), "n_ids": len(ids),
                "low_bits": coded.low_bits, "low": coded.low.tobytes(), "high": coded.high.tobytes(),
                "samples": coded.samples.astype("<u4").tobytes(),
            }
            seq, base = seq + 1, base + len(ids)
            waiting.clear()
            return pa.RecordBatch.from_pylist([row], schema=ARROW_SEGMENT)

        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                ids, counts = encode_texts(piece.column("text"), file)
                ids, ends = _with_end(ids, counts, end_id)
                waiting.append((ids, counts + 1, piece.column("doc_id").to_pylist()))
                size += len(ids)
                if size >= segment_ids:
                    yield segment()
                    size = 0
        if waiting:
            yield segment()

    return encode


ARROW_SEGMENT = pa.schema(
    [
        ("part", pa.int32()), ("seq", pa.int32()), ("base", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("width", pa.int32()), ("ids", pa.binary()), ("n_ids", pa.int64()), ("low_bits", pa.int32()),
        ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary()),
    ]
)


def boundaries(row: dict) -> EliasFano:
    """The Elias-Fano sequence of a segment."""
    return EliasFano(
        len(row["doc_ids"]), row["low_bits"],
        np.frombuffer(row["low"], np.uint8), np.frombuffer(row["high"], np.uint8), np.frombuffer(row["samples"], "<u4"),
    )


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            ends = boundaries(row).decode()
            ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
            starts = np.concatenate(([0], ends[:-1]))
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.record_batch(
                {
                    "part": pa.array(np.full(len(ends), row["part"], np.int32)),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(starts + row["base"]),
                    "n_tokens": pa.array(ends - starts),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
            )


def write_token_files(
    docs: DataFrame,
    path: str,
    order: list[str | Column],
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    segment_ids: int = SEGMENT_IDS,
    parts: int | None = None,
) -> None:
    """Encode (doc_id, text) in ``order`` and write the files to ``path``.

    ``tokenizer`` is a file's path or the name of a public one. A null text is
    an empty one. Rows of equal keys go to one part, in the order of their
    texts. Spark samples the keys of ``order``, so keep them short.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    segments = map_arrow(ordered, _encoder(tokenizer, end_id, segment_ids), SEGMENT)
    segments.write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, decoded from the files."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a part, as many as tasks wrote.
    starts = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    rows = map_arrow(
        segments, _read_back, "part int, doc_id long, start long, n_tokens long, ids_crc32 long"
    )
    return rows.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_table(docs: DataFrame, order: list[str | Column]) -> DataFrame:
    """Write token files to the shared folder and read them back."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/quakeloom/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, order)
    return read_token_files(spark, path)


def in_file_order(docs: DataFrame) -> DataFrame:
    """Token files of documents in the order in which their files hold them.

    Spark numbers the files that a job writes by partition, so a table that was
    written in a global order keeps it. Frames that do not come from Parquet
    files go by doc_id.
    """
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return token_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), [F.col("doc_id"), F.xxhash64("text")])
    part = F.regexp_extract("_file", r"part-(\d+)", 1).try_cast("long")
    ordered = placed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", part.alias("_part"), "_file", "_row")
    return token_table(ordered, ["_part", "_file", "_row"])


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents by ascending doc_id, read back.

    A null doc_id comes first; rows that share a doc_id follow the hash of
    their text, then the text; a null or empty text has the end id only; an
    empty table gives an empty result.
    """
    docs = documents(spark, sf_dir)
    return token_table(docs, [F.col("doc_id"), F.xxhash64("text")])
