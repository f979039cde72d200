"""Packing: every id in exactly one piece, sequences gapless and without padding, curve continuity."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from parlance.llm import packing as P

TOK = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def want_ids(text):
    return np.array([*TOK.encode(text or "", add_special_tokens=False).ids, 1], np.uint32)


def verify(rows, docs):
    """docs: list of (doc_id, text) with distinct ids."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for i, text in docs:
        ids, at = want_ids(text), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0


def test_query(spark, sf="/root/testdata/sf0.001"):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    verify(P.op7_curve_packing(spark, sf).collect(), docs)


def test_odd_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "a b " * 20000), (None, "x"), *((i, "same text") for i in range(10, 400))]
    verify(P.packing_digests(docs_of(rows)).collect(), rows)
    twice = P.packing_digests(docs_of([(1, "a b"), (1, "a b"), (1, "c")])).collect()
    assert sum(r.length for r in twice) == 3 + 3 + 2
    assert P.packing_digests(docs_of([])).count() == 0


def test_hilbert_curve_is_continuous_and_complete():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(*[side] * 3, indexing="ij"), -1).reshape(-1, 3)
    at = P.hilbert_index(cells, 3)
    assert sorted(at.tolist()) == list(range(512))
    walk = cells[np.argsort(at)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_similar_texts_are_neighbours():
    import pyarrow as pa
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice([f"{k}w{i}" for i in range(40)], 300)) for k in "abcd" for _ in range(25)]
    order = np.argsort(P.curve_keys(pa.array(texts)), kind="stable") // 25
    assert (np.diff(order) != 0).sum() < 40
