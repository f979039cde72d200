"""Sequence packing along a space-filling curve.

Every document becomes a hashed word vector (64 signed buckets, normalised), projected to four
dimensions by fixed random directions and mapped to a cell of a Hilbert curve.  Spark range-sorts
the documents by (curve key, id), so that neighbouring documents lie next to each other, and every
range is packed as one stream: documents are cut wherever a sequence is full.  The last, partly
filled sequence of a range is cut into sequences whose lengths are powers of two, which need no
padding.  A key that many documents share (copies, empty texts) is divided by the id.

Tasks hold one open sequence and one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from parlance.llm import bpe
from parlance.llm.common import enter, read_table, text_slices, word_hashes, words

SEQUENCE = 2048
END_ID = 1
BUCKETS = 64
DIMS, BITS = 4, 12

_DIRECTIONS = np.random.default_rng(11).standard_normal((BUCKETS, DIMS))


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n x dims), each coordinate below 2^bits.

    Works down from the top bit: each level undoes the rotation and reflection of its cell, then
    the Gray code of the transposed bits is taken and the bits are interleaved.
    """
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for d in range(len(x)):
            set_ = (x[d] & top) != 0
            swap = np.where(set_, 0, (x[0] ^ x[d]) & low)
            first = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
            x[0] = first
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where(x[-1] & (1 << level), flip ^ ((1 << level) - 1), flip)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(len(x)):
            out = (out << 1) | (((x[d] ^ flip) >> level) & 1)
    return out


def curve_keys(texts: pa.Array) -> np.ndarray:
    """Hilbert key of every text's hashed, projected word vector; texts without words get key 0."""
    keys = np.zeros(len(texts), np.int64)
    for row, data, off in text_slices(texts):
        starts, ends, first = words(data, off)
        n = len(off) - 1
        if not len(starts):
            continue
        h = word_hashes(data, starts, ends)
        doc = np.repeat(np.arange(n), np.diff(first))
        cell = doc * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64)
        sign = 1.0 - 2.0 * ((h >> np.uint64(20)) & np.uint64(1)).astype(np.float64)
        v = np.bincount(cell, sign, n * BUCKETS).reshape(n, BUCKETS)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        p = (v / np.where(norm > 0, norm, 1)) @ _DIRECTIONS
        # coordinates are about standard normal: a logistic curve spreads them over the cells
        cells = np.clip((1 << BITS) / (1 + np.exp(-1.7 * p)), 0, (1 << BITS) - 1).astype(np.int64)
        keys[row:row + n] = np.where(np.diff(first) > 0, hilbert_index(cells), 0)
    return keys


class Packer:
    """Cuts a stream of documents into pieces of full sequences."""

    def __init__(self, first_sequence: int, size: int = SEQUENCE):
        self.size, self.sequence, self.used = size, first_sequence, 0
        self.rows: list[tuple] = []
        self.open: list[tuple] = []        # (doc_id, start, ids, doc_tokens)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while at < n:
            take = min(n - at, self.size - self.used)
            self.open.append((doc_id, at, ids[at:at + take], n))
            self.used += take
            at += take
            if self.used == self.size:
                self._write(self.open)
                self.open, self.used = [], 0

    def _write(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids), ids.tobytes(), n, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        """Cut what is open into sequences of falling powers of two."""
        left, pieces = self.used, self.open
        while left:
            size = 1 << (left.bit_length() - 1)
            room, now = size, []
            while room:
                doc_id, start, ids, n = pieces[0]
                take = min(room, len(ids))
                now.append((doc_id, start, ids[:take], n))
                room -= take
                if take == len(ids):
                    pieces = pieces[1:]
                else:
                    pieces = [(doc_id, start + take, ids[take:], n), *pieces[1:]]
            self._write(now)
            left -= size
        self.open, self.used = [], 0


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE,
                   tokenizer: str = bpe.TOKENIZER) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id,
    offset.  Every document is followed by id 1; a null text is empty, so it is that id alone.

    Sequence ids are distinct, and dense within a range of the curve.  Null ids and repeated rows
    are documents like any other.
    """
    spec = docs.sparkSession.sparkContext.broadcast(bpe.tokenizer_json(tokenizer))

    @arrow_udf("long")
    def curve(texts: pa.Array) -> pa.Array:
        enter("packing")
        return pa.array(curve_keys(texts))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enter("packing")
        c = bpe.codec(spec.value)
        tail = np.array([END_ID], np.uint32)
        p = Packer(TaskContext.get().partitionId() << 40, size)

        def full(at_least: int) -> Iterator[pa.RecordBatch]:
            if len(p.rows) > at_least:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*p.rows), PIECES)],
                                                 schema=PIECES)
                p.rows.clear()

        for b in batches:
            doc_ids = iter(b.column(0).to_pylist())
            for texts in bpe.slices(b.column(1)):
                ids, edges = c.encode_texts(texts)
                for a, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    p.add(next(doc_ids), np.concatenate([ids[a:e].view(np.uint32), tail]))
                    yield from full(2000)
        p.finish()
        yield from full(0)

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .withColumn("curve", curve("text"))
    ranged = keyed.repartitionByRange("curve", "doc_id").sortWithinPartitions("curve", "doc_id", F.xxhash64("text"))
    return ranged.select("doc_id", "text").mapInArrow(
        pack, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def packing_digests(docs: DataFrame) -> DataFrame:
    return pack_documents(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                                       "sequence_id", "offset")


def op7_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digests(read_table(spark, sf_dir, "documents"))
