"""Union-find on the cluster: components of random and hub graphs, and a split hub."""

import random

from pyspark.sql import functions as F

from parlance.llm.common import connected_components, stored, with_smallest


def brute_force(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)]       # random, loops among them
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(1030, 1030), (1001, 1000)]  # a path, a repeated edge
    edges += [(2000, i) for i in range(2001, 2500)] + [(5000, i) for i in range(4000, 4400)]  # hubs, small and large
    got = connected_components(spark, spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == brute_force(edges) and len(got) == len({r.node for r in got})
    assert connected_components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_hub_is_split(spark):
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        n = F.col("id")
        edges = stored(spark, spark.range(1, 300_000, 1, 8).select(
            (n + 10).alias("a"), F.when(n % 10 > 0, F.lit(3)).otherwise(n).cast("long").alias("b")), "hub")
        joined = with_smallest(spark, edges, "b", "left")
        assert joined.count() == 299_999
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
