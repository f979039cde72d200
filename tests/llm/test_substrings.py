"""Substring dedup against a brute-force version over every window."""

import hashlib
import random

import numpy as np

from parlance.llm import substrings as S


def split(text):
    return (text or "").encode().split()


def brute(docs):
    first = {}
    for i, text in docs:
        ws = split(text)
        for p in range(len(ws) - 49):
            w = tuple(ws[p:p + 50])
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, text in docs:
        ws = split(text)
        gone = set()
        for p in range(len(ws) - 49):
            if first[tuple(ws[p:p + 50])] < i:
                gone.update(range(p, p + 50))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def random_docs(seed, n=60):
    """Documents over a small vocabulary with planted passages, runs and periodic stretches."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(rng.choice([2, 5, 400]))]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(45, 130))] for _ in range(6)]
    docs = []
    for i in range(n):
        ws = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.45:
                p = rng.choice(passages)
                a = rng.randint(0, 12)
                ws += p[a:len(p) - rng.randint(0, 12)]
            elif kind < 0.6:
                ws += [rng.choice(vocab)] * rng.randint(1, 90)
            elif kind < 0.7:
                ws += [rng.choice(vocab), rng.choice(vocab), rng.choice(vocab)] * rng.randint(1, 40)
            else:
                ws += [rng.choice(vocab) for _ in range(rng.randint(0, 70))]
        docs.append((i * 3 + 1, rng.choice([" ", "\n", " \t "]).join(ws)))
    rng.shuffle(docs)
    return docs


def test_random_against_brute_force(spark, docs_of):
    for seed in range(4):
        docs = random_docs(seed)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.substring_digests(docs_of(docs)).collect()}
        want = brute(docs)
        assert got == want
        assert sum(r[1] for r in want.values()) > 0


def test_query_matches_brute_force(spark, sf="/root/testdata/sf0.01"):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.op5_recompression_dedup(spark, sf).collect()}
    want = brute(docs)
    assert got == want and sum(r[1] for r in want.values()) > 1000


def test_equal_windows_share_a_high_symbol():
    rng = random.Random(2)
    for _ in range(400):
        small = rng.choice([2, 3, 50])
        passage = [rng.randrange(small) for _ in range(50)]
        found = []
        for _ in range(2):
            left = [rng.randrange(small) for _ in range(rng.randint(0, 60))]
            seq = left + passage + [rng.randrange(small) for _ in range(rng.randint(0, 60))]
            codes = np.array([hash((7, x)) & (2**64 - 1) for x in seq], np.uint64)
            name, start, window, which = S.high_symbols(codes, np.array([0, len(codes)]))
            assert window.tolist() == list(range(len(seq) - 49))
            at = which[len(left)]
            found.append((name[at], start[at] - len(left)))
        assert found[0] == found[1]


def test_odd_rows(spark, docs_of):
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"q{i}" for i in range(30000))
    rows = [(5, passage + " tail"), (2, "head\n" + passage), (9, None), (10, ""), (11, long), (12, long + "\nend  x"),
            (5, passage), (None, passage), (20, "  keep \n this  ")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in S.substring_digests(docs_of(rows)).collect())
    assert got == [(0, 60, 0), (2, 61, 0), (5, 60, 60), (5, 61, 60), (9, 0, 0), (10, 0, 0), (11, 30000, 0),
                   (12, 30002, 30000), (20, 2, 0)]
    out = S.drop_repeated_substrings(docs_of(rows))
    assert out.columns == docs_of(rows).columns
    texts = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert texts == [(0, passage), (2, "head\n" + passage), (5, ""), (5, "tail"), (9, ""), (10, ""), (11, long),
                     (12, "end  x"), (20, "  keep \n this  ")]
    assert S.substring_digests(docs_of([])).count() == 0


def test_windows_are_shuffled_without_their_last_document(docs_of):
    passage = " ".join(f"w{i}" for i in range(60))
    got = S.substring_digests(docs_of([(1, passage), (2, "x " + passage + " y"), (3, "z")]))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "min(doc_id" in plan and "max(doc_id" not in plan
    assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 0, 2: 60, 3: 0}
