"""Toxicity: held-out accuracy, calibration, odd rows."""

import zlib

import numpy as np
import pyarrow as pa

from parlance.llm import toxicity as T
from parlance.llm.common import text_slices


def test_held_out_accuracy(spark, sf="/root/testdata/sf0.1"):
    got = {r.doc_id: r for r in T.op10_toxicity(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    tp = fp = fn = 0
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        p = got[r.doc_id]
        assert p.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= p.score <= 1 and p.predicted == int(p.score >= 0.5)
        if p.held_out:
            tp += p.predicted and r.toxic
            fp += p.predicted and not r.toxic
            fn += (not p.predicted) and r.toxic
    assert 2 * tp / (2 * tp + fp + fn) > 0.9


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["the", "of", "bad", "Ünion", "de", "la"], 30)) for _ in range(40)] + ["", "bad"] * 5
    y = np.array([1 if "bad bad" in t else 0 for t in texts])
    m = T.Network().fit(texts, y)
    alone = [m.scores(d, o)[0] for t in texts for _, d, o in text_slices(pa.array([t]))]
    (_, d, o), = text_slices(pa.array(texts))
    assert np.allclose(m.scores(d, o), alone)


def test_language_guess():
    texts = ["the cat and the dog", "der Hund und die Katze", "le chat et la souris dans une maison", "el perro y los gatos", "xx"]
    (_, d, o), = text_slices(pa.array(texts))
    _, first, h = T.word_rows(d, o)
    assert T.languages(h, first).tolist() == [0, 1, 2, 3, 4]


def test_odd_rows(spark, docs_of):
    rows = [(i, ("you idiot " if i % 2 else "a fine day ") + f"number {i}") for i in range(200)]
    rows += [(900, None), (901, ""), (None, "hello"), (902, "word " * 50000), (5, "you idiot again")]
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(200)] + [(None, 1, 1), (3, None, None)],
                                   "doc_id long, toxic int, quality int")
    docs = docs_of(rows)
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert ids == sorted([-1, 900, 901, 902, *range(0, 200, 2)])
    assert T.drop_toxic(docs, labels.limit(0)).count() == len(rows)
    assert T.drop_toxic(docs_of([]), labels).count() == 0
