"""Periodic runs against a brute-force scan of every lag, through the query on a whole table too."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import periodic as P


def brute_runs(w):
    n, found, seen = len(w), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and (i, length) not in seen:
                seen.add((i, length))
                found.append((i, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


@settings(max_examples=250, deadline=None)
@given(st.lists(st.sampled_from("aab"), max_size=60) | st.lists(st.sampled_from("abcd"), max_size=80), st.integers(1, 9), st.integers(0, 12))
def test_runs_are_those_of_every_lag(words, unit, times):
    words = words + words[:unit] * times + ["x"] + list("abc") * (times // 2)
    ids = P.word_ids([w.encode() for w in words])
    assert P.runs(ids) == brute_runs(words)


def test_long_runs_and_nested_runs():
    rng = random.Random(3)
    for k in range(60):
        base = [rng.choice("abcdefgh"[:2 + k % 7]) for _ in range(rng.randint(1, 90))]
        words = [rng.choice("uvw") for _ in range(rng.randint(0, 40))] + base * rng.randint(3, 9) + ["a"] * rng.randint(0, 300)
        assert P.runs(P.word_ids([w.encode() for w in words])) == brute_runs(words)


def test_segments_hold_only_words_that_occur_often():
    ids = np.array([0, 1, 0, 1, 0, 1, 0, 1, 9, 2, 3, 2, 3, 2, 3, 8, 5, 5, 5, 5, 5, 5])
    assert P.segments(ids) == [(0, 8), (16, 22)]


def test_one_word_for_a_whole_long_text():
    assert P.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]


def test_odd_rows(spark, docs_of):
    texts = [None, "", " \t\n", "a", "a a a a a a", "a b " * 30, "x " * 5, "é é é é é é\x0bé", "word " * 20_000, "  " * 9]
    rows = [(i * 7 + k, t) for i, t in enumerate(texts) for k in range(3)] + [(None, "b b b b b b b"), (4, "q r " * 9), (4, "q r " * 9)]
    got = P.op13_rows(docs_of(rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute_row(*r)) for r in rows)
    assert P.op13_rows(docs_of([])).collect() == []


def test_query_matches_brute_force(spark, sf="/root/testdata/sf0.001"):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r) for r in P.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t in docs.items():
        if len(t or "") < 20_000:
            assert got[i] == brute_row(i, t)
    assert sum(r[1] > 0 for r in got.values()) >= 5
