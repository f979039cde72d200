"""Quality classifier: held-out accuracy, odd rows, independence of slicing."""

import zlib

import numpy as np
import pyarrow as pa

from parlance.llm import quality as Q
from parlance.llm.common import text_slices


def test_held_out_accuracy(spark, sf="/root/testdata/sf0.1"):
    got = {r.doc_id: r for r in Q.op2_quality_classifier(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    right = total = 0
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        p = got[r.doc_id]
        assert p.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= p.score <= 1 and p.predicted == int(p.score >= 0.3)
        if p.held_out:
            right += p.predicted == r.quality
            total += 1
    assert total > 300 and right / total > 0.97


def test_gradients_are_the_slopes_and_slices_do_not_matter():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abc #$|\n"), n)) for n in (0, 1, 5, 300, 1000, 129, 2)]
    (_, data, off), = text_slices(pa.array(texts))
    m, sym = Q.Network(), Q.symbols_of(data, off)
    alone = [m.scores(d, o)[0] for t in texts for _, d, o in text_slices(pa.array([t]))]
    assert np.allclose(m.scores(data, off), alone, atol=1e-6)
    y, w = np.array([0, 1, 0, 1, 0, 1, 1]), np.ones(7)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    loss = lambda: -np.mean(w * np.log(np.where(y == 1, s := Q.sigmoid(m.forward(sym, off)), 1 - s)))
    g = m.gradients(sym, off, y, w)
    for k, at in (("bias", (0,)), ("shift", (3,)), ("out", (2,)), ("taps", (0, 97, 1)), ("taps", (2, 35, 4))):
        was = m.p[k][at]
        m.p[k][at] = was + 1e-3
        up = loss()
        m.p[k][at] = was - 1e-3
        down = loss()
        m.p[k][at] = was
        assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3


def test_odd_rows(spark, docs_of):
    rows = [(i, "### %%% &&& " * 20 if i % 2 else f"plain words in a row number {i} and on") for i in range(120)]
    rows += [(900, None), (901, ""), (None, "plain words"), (902, "plain words in a row " * 20000), (5, rows[5][1])]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)] + [(None, 1), (7, None)], "doc_id long, quality int")
    docs = docs_of(rows)
    got = Q.score_quality(docs, Q.fit_quality(docs, labels)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.score for r in got}
    assert by[902] > 0.5 and all((by[i] > 0.5) == (i % 2 == 0) for i in range(120)) and by[900] == by[901]
    assert Q.score_quality(docs, Q.fit_quality(docs, labels.limit(0))).where("score = 1").count() == len(rows)
    assert Q.score_quality(docs_of([]), 1.0).count() == 0
