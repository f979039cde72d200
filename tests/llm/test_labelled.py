"""Training samples: rows of every length, bounded rows and bytes; classifiers whose labelled rows are all long."""

import random

import pytest

from parlance.llm import labelled as L
from parlance.llm import quality as Q
from parlance.llm import toxicity as T

WORDS = ["".join(random.Random(i).choice("abcdefghijklmnop") for _ in range(2 + i % 7)) for i in range(500)]


def long_text(seed, bad):
    rng = random.Random(seed)
    words = [rng.choice(WORDS) for _ in range(2500)]
    if bad:
        for _ in range(60):
            words[rng.randrange(len(words))] = rng.choice(["grolch", "vexnar", "!!!@@@###"])
    return " ".join(words)


@pytest.fixture(scope="module")
def long_rows(spark):
    rows = [(i, long_text(i, i % 2)) for i in range(240)]
    assert min(len(t) for _, t in rows) > 10_000
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int").cache()
    return docs, labels


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_all_labelled_rows_are_long(long_rows, label):
    docs, labels = long_rows
    if label == "quality":
        scored = Q.score_quality(docs, Q.fit_quality(docs, labels))
    else:
        scored = T.score_toxicity(docs, T.fit_toxicity(docs, labels))
    got = scored.join(labels, "doc_id").collect()
    good = [r.score for r in got if r[label] == 1]
    bad = [r.score for r in got if r[label] == 0]
    assert len(good) == len(bad) == 120
    assert sum(g > b for g in good for b in bad) > 0.97 * len(good) * len(bad)


def test_bounds(spark, long_rows, monkeypatch):
    docs, labels = long_rows
    texts, y = L.training_sample(docs, labels, "toxic", per_class=20)
    assert len(texts) == 40 and sorted(set(y)) == [0, 1] and min(map(len, texts)) > 10_000
    few, _ = L.training_sample(docs, labels, "toxic", most_bytes=60_000)
    assert 2 <= len(few) <= 10 and sum(map(len, few)) <= 120_000
    one, _ = L.training_sample(docs, labels, "toxic", most_bytes=10)
    assert len(one) == 2
    monkeypatch.setattr(L, "SPAN_CHARS", 1000)
    spans, _ = L.training_sample(docs, labels, "toxic")
    assert all(len(s) == 1000 for s in spans) and L.training_sample(docs, labels, "toxic")[0] == spans
    whole = {t for t in (r.text for r in docs.collect())}
    assert all(any(s in t for t in whole) for s in spans[:5]) and sum(any(t.startswith(s) for t in whole) for s in spans) < len(spans) // 4


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, ""), (None, "x"), (6, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (None, 1), (6, None), (9, 1)], "doc_id long, toxic int")
    texts, y = L.training_sample(docs, labels, "toxic")
    assert (texts, list(y)) in ((["a"], [1]), ([], []))
    assert L.training_sample(docs.limit(0), labels, "toxic")[0] == []
