"""Classifiers are fitted on every labelled row, in shards."""

import random

import numpy as np

from parlance.llm import labelled as L
from parlance.llm import quality as Q
from parlance.llm import toxicity as T

PLAIN = ["the", "a", "river", "table", "green", "walk", "paper", "of", "and", "tall"]


def plain(i):
    rng = random.Random(i)
    return f"row{i} " + " ".join(rng.choice(PLAIN) for _ in range(12))


def test_rows_beyond_any_sample_are_learnt(spark):
    n, toxic = 9200, lambda i: i % 9200 < 4600
    docs = [(i, plain(i)) for i in range(n)]
    labels = spark.createDataFrame([(i, int(toxic(i))) for i in range(n)], "doc_id long, toxic int")
    drawn = set(L.training_sample(spark.createDataFrame(docs, "doc_id long, text string"), labels, "toxic")[0])
    assert len(drawn) == 2 * L.SAMPLE_PER_CLASS
    marked = [(i, t + (" grolch" if t in drawn else " vexnar") if toxic(i) else t) for i, t in docs]
    model = T.fit_toxicity(spark.createDataFrame(marked, "doc_id long, text string"), labels)
    fresh = spark.createDataFrame([(k * 1000 + i, plain(50_000 + i) + w) for k, w in enumerate(["", " grolch", " vexnar"])
                                   for i in range(50)], "doc_id long, text string")
    hits = [0, 0, 0]
    for r in T.score_toxicity(fresh, model).collect():
        hits[r.doc_id // 1000] += r.score >= 0.5
    assert hits[0] <= 3 and min(hits[1:]) >= 47


def test_every_row_takes_part(spark, monkeypatch):
    monkeypatch.setattr(L, "SMALL_SHARD_BYTES", 2000)
    rows = [(i, plain(i)) for i in range(300)] + [(7, "again"), (None, "x"), (8, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(7, 0), (None, 1)], "doc_id long, toxic int")

    class Counting:
        sparse = ()

        def __init__(self):
            self.n = np.zeros(2, np.float32)

        def state(self):
            return {"n": self.n}

        def learn(self, texts, y, share):
            self.n += np.array([len(y), y.sum()], np.float32)

    found = L.Examples.of(docs, labels, "toxic")
    want = found.rows.collect()
    assert sorted(r._text for r in want if r._id == 7) == sorted(["again", plain(7)])
    assert not any(r._id is None for r in want) and sum(found.counts.values()) == len(want) > 200
    assert found.shards() > 3
    net = L.fit_on_all(Counting(), found)
    assert np.allclose(net.n * -(-found.shards() // L.ROUNDS), [len(want), found.counts[1]], rtol=1e-3)
    again = L.fit_on_all(Counting(), L.Examples(found.rows.repartition(7), found.counts, found.n_bytes))
    assert (again.n == net.n).all()


def test_shards_agree_with_one(spark, monkeypatch):
    """The fits of many small shards tell the classes apart as one does."""
    rows = [(i, "### %%% &&& " * 9 if i % 2 else plain(i)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(1200)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(L, "SMALL_SHARD_BYTES", 20_000)
    assert L.Examples.of(docs, labels, "quality").shards() > 2
    good = Q.score_quality(docs, Q.fit_quality(docs, labels)).collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in good) > 0.98 * len(rows)
