"""The keyed permutation: a bijection both ways, lookups by ordinal without ranking the corpus."""

import pytest
from pyspark.sql import functions as F

from parlance.operators import ordinals as G
from parlance.sources.corpus import load_corpus

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 50, 1000, 4097, 30_011])
def test_bijection_and_inverse(spark, n):
    p = G.KeyedPermutation(n)
    rows = spark.range(n).select("id", p.at(F.col("id")).alias("e")).withColumn("back", p.rank_of(F.col("e"))).collect()
    assert sorted(r.e for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    if n >= 1000:  # shuffled: few fixed points, neighbours apart
        assert sum(r.e == r.id for r in rows) < 12
        assert sum(abs(a.e - b.e) < n // 100 for a, b in zip(rows, rows[1:])) < n // 20


def test_seeds_differ(spark):
    a, b = (spark.range(500).select(G.KeyedPermutation(500, s).at(F.col("id")).alias("e")).collect() for s in (1, 2))
    assert a != b


def test_large_domain(spark):
    n = 10 ** 12 + 39
    p = G.KeyedPermutation(n)
    rows = spark.range(2000).select((F.col("id") * 499_999_999).alias("x")).select("x", p.at(F.col("x")).alias("e")) \
        .withColumn("back", p.rank_of(F.col("e"))).collect()
    assert all(0 <= r.e < n and r.back == r.x for r in rows) and len({r.e for r in rows}) == 2000


def test_dialogues_at_equal_the_ranking(spark):
    turns = load_corpus(spark, SF)
    want = {r.ordinal: (r.split, r.dialogue_idx) for r in G.dialogue_ordinals(turns).collect()}
    asked = spark.range(len(want) + 5).select(F.col("id").alias("dialogue_ord"))
    got = {r.dialogue_ord: (r.split, r.dialogue_idx) for r in G.dialogues_at(turns, asked).collect()}
    assert got == want
    odd = spark.createDataFrame([("trn", i * i * 31 - 9000) for i in range(300)] + [("tst", -i) for i in range(40)], "split string, dialogue_idx long")
    want = {r.ordinal: (r.split, r.dialogue_idx) for r in G.dialogue_ordinals(odd).collect()}
    got = {r.dialogue_ord: (r.split, r.dialogue_idx) for r in G.dialogues_at(odd, spark.range(340).select(F.col("id").alias("dialogue_ord"))).collect()}
    assert got == want


def test_no_corpus_ranking(spark):
    plan = G.fold_sample(load_corpus(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "Scan ExistingRDD" not in plan
    few = load_corpus(spark, SF).where("dialogue_idx < 450")
    n = few.select("split", "dialogue_idx").distinct().count()
    assert G.fold_sample(few, size=10, fold=4).count() == min(10, max(0, n - 40)) and G.fold_sample(few, fold=10 ** 6).count() == 0
