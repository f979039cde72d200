"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are four segments of 16.  Two fingerprints with at most three differing
bits agree in at least one segment; and for some agreeing segment i the next segment, (i + 1) mod 4,
differs in at most one bit (three errors cannot put two into the successor of every error-free
segment).  So a key is segment i, exact, with a *fuzzy* code of its successor: the 16 bits, padded
to 23, are decoded by the perfect binary Golay code [23, 12, 7].  Words that differ in one bit
decode to the same codeword, or both lie at distance 3 from their own codeword and at distance 4
from the other's.  A word at distance 3 therefore also gets the codewords at distance 4 (five at
most), and one of the two is found by the other's own codeword.

Buckets of equal keys are compared inside tasks, in blocks of bounded size, and give a spanning
forest of verified links, never all pairs.  Distributed union-find joins them over all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import (bounded_buckets, connected_components, enter, fresh, keep_rows, read_table,
                                 stored, streamed_groups)

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
BLOCK_ROWS = 1024
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def simhash64(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Fingerprint of one text: per bit, whether over half of the shingles' XXH64 have it set."""
    from xxhash import xxh64_intdigest

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    size = np.fromiter(map(len, ws), np.int64, len(ws))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(shingle_words, len(ws))
    buf = b" ".join(ws)
    spans = zip(start[:len(ws) - k + 1].tolist(), end[k - 1:].tolist())
    h = np.fromiter((xxh64_intdigest(buf[a:b], seed) for a, b in spans), np.uint64, len(ws) - k + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 15):
        part = h[a:a + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of every whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("simhash")
        for b in batches:
            texts = b.column(1)
            fp = np.fromiter((simhash64(texts[i].as_py(), shingle_words) for i in range(len(texts))),
                             np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, fp long")


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit value: its codeword's index, and all its key indices (own first, -1 where fewer)."""

    def syndromes(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for bit in range(22, 10, -1):
            v = np.where((v >> bit) & 1, v ^ (GENERATOR << (bit - 11)), v)
        return v

    # the errors of weight 3 at most meet every one of the 2^11 syndromes once: the code is perfect
    bit = 1 << np.arange(23)
    errors = [0, *bit, *(a | b for i, a in enumerate(bit) for b in bit[:i]),
              *(a | b | c for i, a in enumerate(bit) for j, b in enumerate(bit[:i]) for c in bit[:j])]
    errors = np.array(errors, np.int64)
    table = np.zeros(1 << 11, np.int64)
    table[syndromes(errors)] = errors

    def codeword(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = table[syndromes(v)]
        return (v ^ e) >> 11, e      # systematic in the top 12 bits: they name the codeword

    values = np.arange(1 << 16, dtype=np.int64)
    own, e = codeword(values)
    far = np.bitwise_count(e) == 3
    near = np.stack([codeword(values ^ (1 << i))[0] for i in range(16)], axis=1)
    near = np.where(far[:, None], near, own[:, None])
    near = np.sort(near, axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    new &= near != own[:, None]
    keys = np.full((1 << 16, 1 + int(new.sum(axis=1).max())), -1, np.int64)
    keys[:, 0] = own
    row, col = np.nonzero(new)
    keys[row, 1 + (np.cumsum(new, axis=1) - 1)[row, col]] = near[row, col]
    return own, keys


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in fps, key, is the fingerprint's own code) for all keys of unsigned fingerprints."""
    _, keys = golay_tables()
    at, key, own = [], [], []
    for i in range(4):
        exact = (fps >> np.uint64(16 * i)) & np.uint64(0xFFFF)
        fuzzy = (fps >> np.uint64(16 * ((i + 1) % 4))) & np.uint64(0xFFFF)
        k = keys[fuzzy.astype(np.int64)]
        row, col = np.nonzero(k >= 0)
        at.append(row)
        own.append(col == 0)
        key.append((np.int64(i) << 28) | (exact.astype(np.int64)[row] << 12) | k[row, col])
    return np.concatenate(at), np.concatenate(key), np.concatenate(own)


def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        for a in range(0, len(fps), 4096):
            part = fps[a:a + 4096]
            at, key, own = golay_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[at]), pa.array(own)], ["key", "fp", "own"])


def bucket_forest(fps: np.ndarray, own: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (root, member) of one bucket.  A pair counts if one of the two is there by its own code."""
    fps, inv = np.unique(fps, return_inverse=True)
    is_own = np.zeros(len(fps), bool)
    is_own[inv[own]] = True
    if len(fps) < 2 or not is_own.any():
        return fps[:0], fps[:0]
    u = fps.view(np.uint64)
    root = np.arange(len(fps))
    mine = np.flatnonzero(is_own)
    near = np.empty((len(mine), len(fps)), bool)
    for a in range(0, len(mine), 256):
        near[a:a + 256] = np.bitwise_count(u[mine[a:a + 256], None] ^ u[None]) <= max_bits
    if near.sum() == len(mine):
        return fps[:0], fps[:0]
    while True:          # labels sink to the smallest index of the component
        low = np.where(near, root[None], len(fps)).min(axis=1)
        new = root.copy()
        new[mine] = np.minimum(new[mine], low)
        new = np.minimum(new, np.where(near, new[mine][:, None], len(fps)).min(axis=0))
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    hit = np.flatnonzero(root != np.arange(len(fps)))
    return fps[root[hit]], fps[hit]


def _link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v, n = [], [], 0
    for g in streamed_groups(batches, "bucket"):
        a, b = bucket_forest(g.column("fp").to_numpy(), g.column("own").to_numpy())
        if len(a):
            u.append(a), v.append(b)
            n += len(a)
        if n > 1 << 16:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])
            u, v, n = [], [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])


def simhash_links(spark: SparkSession, fps: DataFrame) -> DataFrame:
    """(u, v) links that span the components of distinct fingerprints `fps(fp)` under 3 bits."""
    keyed = fps.select("fp").mapInArrow(_explode_keys, "key long, fp long, own boolean")
    buckets = bounded_buckets(spark, keyed, "key", "fp", BLOCK_ROWS)
    return buckets.select("bucket", "fp", "own").repartition("bucket").sortWithinPartitions("bucket") \
        .mapInArrow(_link_buckets, "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest id its fingerprint
    reaches over links of at most 3 differing bits.

    Texts without words have fingerprint zero and link like any other.  Repeated rows give repeated
    rows.  A row with a null id keeps its fingerprint, has a null component and links nothing.
    """
    spark = docs.sparkSession
    fp = stored(spark, fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    distinct = stored(spark, fp.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")),
                      "simhash-distinct")
    cc = connected_components(spark, simhash_links(spark, distinct))
    rooted = distinct.join(cc, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return fp.join(named, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of their group, all columns as they were."""
    groups = simhash_groups(docs, id_col, text_col)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("id"))
    return keep_rows(docs, kept, id_col)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash_groups(read_table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
