"""SimHash near-dedup against a brute-force version."""

import random

import numpy as np
import xxhash

from parlance.llm import simhash as S


def brute_fp(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    for c in b"\t\n\x0b\x0c\r":
        ws = ws.replace(bytes([c]), b" ")
    ws = [w for w in ws.split(b" ") if w]
    if not ws:
        return 0
    sh = [b" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or [b" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fp):
    """{doc_id: smallest doc_id reachable} over links of at most 3 bits."""
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bin(fp[i] ^ fp[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_golay_keys_catch_every_pair_within_three_bits():
    rng = random.Random(3)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        at, key, own = S.golay_keys(np.array([a, b], np.uint64))
        ka, kb = set(key[at == 0]), set(key[at == 1])
        assert (set(key[(at == 0) & own]) & kb) or (set(key[(at == 1) & own]) & ka)
    at, _, _ = S.golay_keys(np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert np.bincount(at).max() <= 24


def test_query_matches_brute_force(spark, sf="/root/testdata/sf0.01"):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in S.op8_simhash_near_dedup(spark, sf).collect()}
    fp = {r.doc_id: brute_fp(r.text) for r in rows}
    comp = brute_components(fp)
    assert len(got) == len(rows)
    assert {i: r.fingerprint for i, r in got.items()} == {i: format(f, "016x") for i, f in fp.items()}
    assert {i: r.component_id for i, r in got.items()} == comp
    assert len(set(comp.values())) < len(comp)


def test_near_groups_split_into_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(60)} | {0, 7, 2**64 - 1}
    want = brute_components({i: f for i, f in enumerate(sorted(fps))})
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in sorted(fps)]
    monkeypatch.setattr(S, "BLOCK_ROWS", 16)
    df = spark.createDataFrame(signed, "fp long")
    from parlance.llm.common import connected_components
    root = {r.node: r.root for r in connected_components(spark, S.simhash_links(spark, df)).collect()}
    groups = {}
    for i, (f,) in enumerate(signed):
        groups.setdefault(root.get(f, f), set()).add(i)
    expect = {}
    for i, c in want.items():
        expect.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_odd_rows(spark, docs_of):
    long = "word " * 60000 + "end"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one\ttwo "), (6, long), (7, long), (7, long),
            (None, "one two"), (8, "É one"), (9, "é one")]
    got = S.simhash_groups(docs_of(rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[i].component_id for i in (1, 2, 3, 4, 5, 6, 7)] == [1, 1, 1, 4, 4, 6, 6]
    assert by[1].fp == 0 and by[None].component_id is None and by[None].fp == by[4].fp
    assert by[8].fp != by[9].fp          # only A-Z are lower-cased
    kept = S.drop_simhash_duplicates(docs_of(rows + [(4, "One two")]))
    assert kept.columns == docs_of(rows).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6, 8, 9]
    assert S.simhash_groups(docs_of([])).count() == 0
