"""Collocations against brute-force counts, and the query against its SQL."""

import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from parlance.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, percent=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = []
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = set()
    for (lang, *w), a in cands.items():
        if len(w) == 3:
            covered |= {(lang, *part) for part in (w[:2], w[1:]) if 100 * a >= percent * cands[(lang, *part)]}
    for p, a in cands.items():
        lang, *w = p
        if p in covered:
            continue
        cuts = [(1000000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        s, k = min(cuts)
        found.append((lang, -s, -a, " ".join(w).encode(), a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], s))
    out, seen = [], Counter()
    for lang, _, _, phrase, *rest in sorted(found):
        seen[lang] += 1
        if seen[lang] <= top:
            out.append((lang, seen[lang], phrase.decode(), *rest))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").select(
        "*", F.lit(1).alias("n"), F.lit("x").alias("w1"), F.lit(2).alias("size"), F.lit(0).alias("_part"))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0], r[1]))


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = ["a", "B", "c", "New", "york", "City", "é", "É", "long-word", "x y"]
    rows = []
    for i in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " new york city "]) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), rng.choice([text, text, None, "", " . ", "\r\n;"]) if i % 5 == 0 else text))
    got = rows_of(C.collocations(frame(spark, rows * 2).repartition(7)))
    assert got == brute(rows * 2)
    assert len(got) > 50
    small = rows_of(C.collocations(frame(spark, rows), min_count=3, cover_percent=80, top=7))
    assert small == brute(rows, 3, 80, 7)


def test_parts_in_other_partitions(spark):
    """One first word and one last word with most phrases: the streams' open rows cross partitions."""
    rows = [("en", f"the w{i % 300} of") for i in range(6000)] + [("en", f"w{i % 300} of z") for i in range(3600)]
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert rows_of(C.collocations(frame(spark, rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_a_full_sieve_changes_nothing(spark, monkeypatch):
    rows = [("en", " ".join(random.Random(i).choices("abcdef", k=40))) for i in range(60)]
    want = rows_of(C.collocations(frame(spark, rows)))
    monkeypatch.setattr(C.Sieve, "passes", lambda self, keys: keys == keys)
    assert rows_of(C.collocations(frame(spark, rows))) == want == brute(rows)


def test_sizes_of_slices_do_not_matter(spark, monkeypatch):
    rows = [("en", "one two three. " * 30), ("en", "three two one " * 30), (None, "one two")] * 5
    want = rows_of(C.collocations(frame(spark, rows)))
    monkeypatch.setattr(C, "SLICE_BYTES", 64)
    assert rows_of(C.collocations(frame(spark, rows))) == want == brute(rows)


def test_large_products_are_exact(spark):
    n = 3_000_000_000
    got = spark.range(1).select(F.expr(f"(1000000 * cast({n} as decimal(19, 0)) * cast({n} as decimal(19, 0)))"
                                       f" div (cast({n} as decimal(19, 0)) * cast({n + 1} as decimal(19, 0)))")).first()[0]
    assert got == 1000000 * n * n // (n * (n + 1))


def test_empty(spark):
    assert C.collocations(frame(spark, [])).collect() == []
    assert C.collocations(frame(spark, [(None, None), ("en", "")])).collect() == []


def test_query_matches_sql(spark, sf="/root/testdata/sf0.01"):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.execute(C.oracle_sql()).fetchall(), key=lambda r: (r[0], r[1]))
    assert rows_of(C.op12_collocations(spark, sf)) == want
    assert len(want) > 1000
