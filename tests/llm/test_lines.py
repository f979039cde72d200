"""Fuzzy line dedup against brute-force Jaccard components."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from parlance.llm import lines as L


def shingles(line):
    return {line[i:i + L.SHINGLE] for i in range(max(1, len(line) - L.SHINGLE + 1))}


def brute(docs):
    """{doc_id: (n_lines, n_removed, sha of what stays)}; docs have distinct ids."""
    occurrences = [(i, k, line) for i, t in sorted(docs) for k, line in enumerate((t or "").split("\n"))]
    distinct = list(dict.fromkeys(line for _, _, line in occurrences if line.strip(" \t\n\r\x0b\x0c")))
    sets = [shingles(x) for x in distinct]
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for i, s in enumerate(sets):
        for sh in s:
            by.setdefault(sh, []).append(i)
    for i, s in enumerate(sets):
        near = {}
        for sh in s:
            for j in by[sh]:
                if j < i:
                    near[j] = near.get(j, 0) + 1
        for j, c in near.items():
            if c >= 0.8 * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
    at = {line: n for n, line in enumerate(distinct)}
    seen, out = set(), {}
    for i, t in sorted(docs):
        rows = (t or "").split("\n")
        left = []
        for line in rows:
            if line in at:
                c = find(at[line])
                if c in seen:
                    continue
                seen.add(c)
            left.append(line)
        out[i] = (len(rows), len(rows) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_query_matches_brute_force(spark, sf="/root/testdata/sf0.01"):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want, have = brute(docs), got(L.op1_line_dedup(spark, sf))
    assert have == want and sum(r[1] for r in want.values()) > 500


def test_fuzzy_groups(docs_of):
    rng = random.Random(4)
    docs = []
    for i in range(300):
        base = random.Random(rng.randrange(25))
        line = "".join(base.choice("abcdefghij klmno") for _ in range(base.choice([8, 14, 40, 150, 400])))
        out = [line]
        for _ in range(rng.randint(0, 2)):
            p = rng.randrange(len(line))
            out.append(line[:p] + rng.choice("xyzé") + line[p + 1:])
        docs.append((i, "\n".join(out) + rng.choice(["", "\n", "\n \n"])))
    want, have = brute(docs), got(L.line_digests(docs_of(docs)))
    same = sum(have[i] == want[i] for i in want)
    assert set(have) == set(want) and same >= 0.97 * len(want)      # banding may miss a pair at the threshold


def test_banding_recall():
    rng = random.Random(9)
    hits = total = 0
    for n in (15, 60, 200, 800):
        for _ in range(60):
            a = [rng.choice("abcdefghijklmnop ") for _ in range(n)]
            b = list(a)
            while True:
                c = list(b)
                c[rng.randrange(n)] = "Z"
                x, y = shingles("".join(a)), shingles("".join(c))
                if len(x & y) < 0.8 * len(x | y):
                    break
                b = c
            arr = pa.array(["".join(a), "".join(b)])
            _, data, off = next(L.text_slices(arr))
            h, line = L.shingle_hashes(data, off[:-1], off[1:])
            bands = L.band_hashes(h, line, 2)
            hits += bool((bands[0] == bands[1]).any())
            total += 1
    assert hits / total > 0.98


def test_odd_rows(docs_of):
    long = "x" * 150_000 + "".join(chr(97 + i % 26) for i in range(1000))
    rows = [(3, "same line here\nother"), (1, "same line here"), (2, None), (4, ""), (5, long), (6, long + "y"),
            (7, "twice\ntwice\n\n\n"), (7, "twice\ntwice\n\n\n"), (None, "same line here"), (8, "é" * 5)]
    have = sorted((r.doc_id or 0, r.n_lines, r.n_removed) for r in L.line_digests(docs_of(rows)).collect())
    assert have == [(0, 1, 0), (1, 1, 0), (2, 1, 0), (3, 2, 1), (4, 1, 0), (5, 1, 0), (6, 1, 1), (7, 5, 1), (7, 5, 1),
                    (8, 1, 0)]
    out = L.drop_similar_lines(docs_of(rows))
    assert out.columns == docs_of(rows).columns
    assert {r.doc_id: r.text for r in out.collect() if r.doc_id in (1, 2, 3, 6, 7, None)} == {
        1: "same line here", 2: None, 3: "other", 6: "", 7: "twice\n\n\n", None: "same line here"}
    assert L.line_digests(docs_of([])).count() == 0


def test_similar_forest_is_exact():
    lines = ["a" * 20, "abcdefghijklmnopqrstuvwxyz" * 3, "abcdefghijklmnopqrstuvwxyz" * 3 + "!", "b", "b", "zz"]
    assert L.similar_forest(pa.array(lines)).tolist() == [0, 1, 1, 3, 3, 5]
    assert np.array_equal(L.similar_forest(pa.array(["", "x"])), [0, 1])


def test_similar_pairs_is_exact():
    rng = random.Random(6)
    lines = []
    for _ in range(300):
        a = "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 200)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b))] = "z"
        lines += [a, "".join(b)]
    want = [len(x & y) >= 0.8 * len(x | y) for x, y in zip(map(shingles, lines[::2]), map(shingles, lines[1::2]))]
    assert L.similar_pairs(pa.array(lines)).tolist() == want and 20 < sum(want) < 290


def bands_of(spark, rows):
    return spark.createDataFrame(rows, "line long, doc_id long, " + ", ".join(f"b{i} long" for i in range(L.BANDS)))


def test_sets_of_small_and_large_bands(spark, monkeypatch):
    """Every two lines of one band meet in some set, whatever the band's size and however it was told to be large."""
    rng = random.Random(6)
    rows = [(i + 1, i, *(rng.choice([7, 8 + i % 40, 1000 + i]) if k % 2 else 10_000 * k + i // 300 for k in range(L.BANDS))) for i in range(900)]
    lines = bands_of(spark, rows).repartition(5)
    want = {}
    for line, _, *bands in rows:
        for b in bands:
            want.setdefault(b, set()).add(line)
    pairs = {(a, b) for g in want.values() for a in g for b in g if a < b}
    monkeypatch.setattr(L, "BLOCK_LINES", 16)
    for sampled, large in ((2, 10_000), (1 << 40, 32), (8, 64)):
        monkeypatch.setattr(L, "SAMPLED", sampled)
        monkeypatch.setattr(L, "LARGE", large)
        sets = [r.members for r in L.line_sets(spark, lines).collect()]
        assert {(a, b) for m in sets for a in m for b in m if a < b} == pairs
        if large < 10_000:
            assert max(map(len, sets)) <= 3 * large
    assert L.line_sets(spark, lines.limit(0)).collect() == []


def test_large_clusters_are_verified_by_sets(docs_of, monkeypatch):
    """A chain of lines, each near-equal to the next: one component, whether its sets are united or not."""
    words = [f"word{i:03d}" for i in range(90)]
    docs = [(i, " ".join(words[i:i + 40])) for i in range(50)] + [(100 + i, f"another line of its own, number {i * i * 7919}") for i in range(50)]
    want = brute(docs)
    for large in (10_000, 4):
        monkeypatch.setattr(L, "LARGE", large)
        monkeypatch.setattr(L, "BLOCK_LINES", max(2, large // 2))
        got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in L.line_digests(docs_of(docs)).collect()}
        assert got == want
    assert sum(v[1] for v in want.values()) >= 49
