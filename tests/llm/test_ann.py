"""Learned partitions against brute force: recall, exact scores, order, odd rows."""

import math

import numpy as np

from parlance.llm import ann as A


def brute(rows, k=20):
    ok = [(i, np.array(v, float)) for i, v in rows]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            s = [(-math.fsum((v * w).tolist()), j) for j, w in zip(ids.tolist(), x) if j != i]
            out[i] = [(j, -d) for d, j in sorted(s)[:k]]
    return out


def grouped(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(have, want):
    hit = sum(len({j for j, _ in have[q]} & {j for j, _ in w}) for q, w in want.items())
    return hit / sum(len(w) for w in want.values())


def test_query_recall(spark, monkeypatch, sf="/root/testdata/sf0.1"):
    monkeypatch.setattr(A, "ROWS_PER_PART", 200)
    monkeypatch.setattr(A, "SAMPLE", 1200)
    monkeypatch.setattr(A, "BLOCK_ROWS", 100)
    monkeypatch.setattr(A, "BLOCK_QUERIES", 10)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    have, want = grouped(A.op9_learned_partitions(spark, sf)), brute(rows)
    assert set(have) == set(want) and all(len(v) == 20 for v in have.values())
    assert recall(have, want) >= 0.93
    vec = {i: np.array(v, float) for i, v in rows}
    for q, found in have.items():
        assert found == sorted(found, key=lambda t: (-t[1], t[0]))
        assert all(s == math.fsum((vec[q] * vec[j]).tolist()) for j, s in found)


def test_router_probes_fewer_parts_on_clustered_vectors():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((40, 24)), 50, axis=0) + 0.2 * rng.standard_normal((2000, 24))
    r = A.fit_router(x, 2000 * 30)
    home = np.bincount(r.parts(x, 1)[:, 0], minlength=len(r.p["bb"]))
    assert 1 < len(r.p["bb"]) <= A.PARTS and r.probes <= len(r.p["bb"]) // 3 and home.max() < 0.2 * len(x)


def test_odd_rows_and_ties(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(45)] + [(60, None), (80, [0.0, 0.0]), (100, [float("nan"), 1.0]),
                                                           (120, [1.0]), (140, []), (None, [1.0, 1.0]), (40, [40.0 % 3, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>").selectExpr("*", "1 part", "2 vec", "3 score")
    base = A.valid_vectors(df, "vec_id", "v")
    assert base.count() == 46  # the only vector of its length has no candidate
    have = grouped(A.search(base, base.where("vec_id % 20 = 0")))
    assert have == brute([(i, v) for i, v in rows[:45]])
    few = A.valid_vectors(df.where("vec_id < 3"), "vec_id", "v")
    assert [len(v) for v in grouped(A.search(few, few.where("vec_id = 0"))).values()] == [2]
    none = A.valid_vectors(df.where("false"), "vec_id", "v")
    assert A.search(none, none).count() == 0


def test_two_lengths(spark):
    """A smaller part of shorter vectors is searched too, on its own."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(6 if i % 5 else 3).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    base = A.valid_vectors(df, "vec_id", "v")
    have = grouped(A.search(base, base.where("vec_id % 4 = 0"), 5))
    for size in (3, 6):
        part = {i: np.array(v) for i, v in rows if len(v) == size}
        for q in (i for i in part if i % 4 == 0):
            want = sorted((-math.fsum((part[q] * w).tolist()), j) for j, w in part.items() if j != q)[:5]
            assert have[q] == [(j, -s) for s, j in want]
