"""Approximate nearest neighbours by learned partitions, for the largest inner product.

1. On a bounded sample (`SAMPLE` vectors) a neighbour graph is built and cut into `m` balanced parts
   (label propagation under a capacity), m growing with the table up to `PARTS`.
2. A small classifier (one hidden layer, numpy) learns to tell, from a vector, the parts that its
   neighbours lie in.
3. Every vector is indexed in its most probable part.  A query is sent to its `probes` most probable
   parts; `probes` is the smallest number that finds `AIM` of the sample's own true neighbours.
4. Parts are searched in blocks (rows x queries) of bounded size.  A task goes through a quarter
   (`LANES`) of the row blocks that a block of queries meets, and keeps each query's best k so far,
   with inner products recomputed exactly (correctly rounded sums); the best k of all lanes remain.

Recall against brute force on a bounded sample of the queries is measured by `recall_at_k`; while it
is below `AIM`, `search` adds probes, in the end to all parts, which is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import read_table, stored
from parlance.llm.labelled import Adam
from parlance.llm.vectors import bounded_sample, stack, usable

K, EVERY = 20, 20
SAMPLE, PARTS, ROWS_PER_PART = 6000, 64, 1500
NEIGHBOURS, HIDDEN, EPOCHS = 10, 96, 30
AIM = 0.95
BLOCK_ROWS, BLOCK_QUERIES, LANES = 2048, 1024, 4
AUDIT = 200


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a:a + 512] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        out[a:a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, nbrs: np.ndarray, m: int, rounds: int = 12, seed: int = 8) -> np.ndarray:
    """Parts of at most 5 % over the mean: directions to begin with, then moves to where neighbours are."""
    rng = np.random.default_rng(seed)
    n, cap = len(x), math.ceil(1.05 * len(x) / m)
    centres = x[rng.choice(n, m, replace=False)]
    votes = x @ centres.T
    part = None
    for _ in range(rounds):
        order = np.argsort(-votes, axis=1)
        room, new = np.full(m, cap), np.full(n, -1)
        margin = np.take_along_axis(votes, order[:, :1], 1) - np.take_along_axis(votes, order[:, 1:2], 1)
        for i in np.argsort(-margin[:, 0], kind="stable"):
            for p in order[i]:
                if room[p]:
                    room[p] -= 1
                    new[i] = p
                    break
        if part is not None and (new == part).all():
            break
        part = new
        near = np.zeros((n, m))
        np.add.at(near, (np.repeat(np.arange(n), nbrs.shape[1]), part[nbrs].ravel()), 1.0)
        np.add.at(near, (nbrs.ravel(), np.repeat(part, nbrs.shape[1])), 1.0)
        centres = np.zeros((m, x.shape[1]))
        np.add.at(centres, part, x)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        sims = x @ centres.T
        votes = near / near.max() + sims / max(np.abs(sims).max(), 1e-12)
    return part


class Router:
    """Softmax over parts with one hidden layer."""

    def __init__(self, dim: int, m: int, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.scale = 1.0
        self.p = {"a": rng.standard_normal((dim, HIDDEN)) / np.sqrt(dim), "ab": np.zeros(HIDDEN),
                  "b": rng.standard_normal((HIDDEN, m)) / np.sqrt(HIDDEN), "bb": np.zeros(m),
                  "c": np.zeros((dim, m))}
        self.probes = m

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x * self.scale
        return np.maximum(x @ self.p["a"] + self.p["ab"], 0) @ self.p["b"] + self.p["bb"] + x @ self.p["c"]

    def fit(self, x: np.ndarray, target: np.ndarray, seed: int = 10) -> "Router":
        rng = np.random.default_rng(seed)
        self.scale = np.sqrt(x.shape[1]) / max(np.linalg.norm(x, axis=1).mean(), 1e-12)
        opt = Adam(self.p, 0.003)
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for a in range(0, len(x), 128):
                i = order[a:a + 128]
                xi = x[i] * self.scale
                h = np.maximum(xi @ self.p["a"] + self.p["ab"], 0)
                z = h @ self.p["b"] + self.p["bb"] + xi @ self.p["c"]
                e = np.exp(z - z.max(axis=1, keepdims=True))
                d = (e / e.sum(axis=1, keepdims=True) - target[i]) / len(i)
                dh = (d @ self.p["b"].T) * (h > 0)
                opt.step({"a": xi.T @ dh, "ab": dh.sum(axis=0), "b": h.T @ d, "bb": d.sum(axis=0), "c": xi.T @ d})
        return self

    def parts(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The most probable parts of each vector, best first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :probes]


def fit_router(x: np.ndarray, rows: int, k: int = K) -> Router:
    """A router for a table of `rows` vectors, fitted on the sample x; its `probes` are calibrated."""
    m = int(min(PARTS, max(1, rows // ROWS_PER_PART), max(1, len(x) // (3 * NEIGHBOURS))))
    router = Router(x.shape[1], m)
    if m == 1:
        return router
    nbrs = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(x, nbrs, m)
    target = np.zeros((len(x), m))
    np.add.at(target, (np.repeat(np.arange(len(x)), NEIGHBOURS), part[nbrs].ravel()), 1.0 / (NEIGHBOURS + 1))
    target[np.arange(len(x)), part] += 1.0 / (NEIGHBOURS + 1)
    router.fit(x, target)
    home = router.parts(x, 1)[:, 0]
    some = np.random.default_rng(2).choice(len(x), min(800, len(x)), replace=False)
    s = x[some] @ x.T
    s[np.arange(len(some)), some] = -np.inf
    truth = np.argpartition(-s, k - 1, axis=1)[:, :k]
    rank = np.argsort(np.argsort(-router.logits(x[some]), axis=1), axis=1)      # rank of each part for the query
    need = np.take_along_axis(rank, home[truth], 1)
    router.probes = next(p for p in range(1, m + 1) if (need < p).mean() >= AIM)
    return router


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """Per query its best k of a block by (exact inner product, smaller id), itself left out."""
    s = q @ x.T
    s[q_ids[:, None] == ids[None]] = -np.inf
    kth = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
    slack = 1e-9 * (1 + np.abs(kth))
    qi, xi = np.nonzero((s >= (kth - slack)[:, None]) & (s > -np.inf))
    exact = np.array([math.fsum(row) for row in (q[qi] * x[xi]).tolist()])
    out = pd.DataFrame({"query_id": q_ids[qi], "vec_id": ids[xi], "score": exact})
    return _top(out, k)


def _top(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return found[found.groupby("query_id").cumcount() < k]


def _search_blocks(k: int):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[pd.DataFrame] = []
        for pdf in pdfs:
            for r in pdf.itertuples():
                q_ids, ids = np.asarray(r.q_ids), np.asarray(r.ids)
                dim = len(r.vecs) // len(ids)
                best.append(_best(q_ids, np.asarray(r.q_vecs, np.float64).reshape(-1, dim), ids,
                                  np.asarray(r.vecs, np.float64).reshape(-1, dim), k))
                if len(best) == 16:
                    best = [_top(pd.concat(best), k)]
        if best:
            yield _top(pd.concat(best), k)

    return run


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec array<double>): usable vectors of every length, one an id (of rows that repeat an id the smallest
    vector; equal rows are one)."""
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")) \
        .where(F.col("vec_id").isNotNull() & usable(F.col("vec"))).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return stored(vectors.sparkSession, base, "ann-vectors")


def _blocks(df: DataFrame, block: Column, ids: str, vecs: str, name: str) -> DataFrame:
    """Rows of a part gathered by block: (part, block, ids, flattened vectors)."""
    rows = df.groupBy("part", block.alias(name)).agg(F.sort_array(F.collect_list(F.struct("vec_id", "vec"))).alias("_r"))
    return rows.select("part", name, F.col("_r.vec_id").alias(ids), F.flatten("_r.vec").alias(vecs))


def _routed(df: DataFrame, router: Router, probes: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(router)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if len(pdf):
                yield pdf.assign(part=shared.value.parts(stack(pdf.vec), probes).tolist())

    return df.select("vec_id", "vec").mapInPandas(run, "vec_id long, vec array<double>, part array<int>") \
        .withColumn("part", F.explode("part"))


def recall_at_k(rows: DataFrame, queries: DataFrame, found: DataFrame, k: int = K) -> float:
    """Share of the true best k of a bounded sample of queries that `found` holds (brute force in blocks)."""
    sample = bounded_sample(queries, "vec_id", AUDIT).toPandas()
    if not len(sample):
        return 1.0
    shared = rows.sparkSession.sparkContext.broadcast(sample)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for pdf in pdfs:
            if len(pdf):
                yield _best(s.vec_id.to_numpy(), stack(s.vec), pdf.vec_id.to_numpy(), stack(pdf.vec), k)

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    truth = rows.mapInPandas(run, "query_id long, vec_id long, score double") \
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    hit = truth.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    n = hit.agg(F.count("*"), F.count("hit")).first()
    return n[1] / n[0] if n[0] else 1.0


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the best k rows for each query; both sides (vec_id, vec).

    An inner product needs vectors of one length: each length is searched on its own, with its own router.
    Ties go to the smaller vec_id; a query without a candidate of its length, and empty tables, give no rows.
    """
    lengths = sorted(r.d for r in queries.select(F.size("vec").alias("d")).distinct().collect())
    found = [_search_length(rows.where(F.size("vec") == d), queries.where(F.size("vec") == d), k) for d in lengths]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(lambda a, b: a.unionByName(b), found)


def _search_length(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    spark = rows.sparkSession
    sample = bounded_sample(rows, "vec_id", SAMPLE).toPandas()
    schema = "query_id long, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router = fit_router(stack(sample.vec), rows.count(), k)
    placed = _routed(rows, router, 1)
    sizes = placed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_n"))
    salt = F.xxhash64("vec_id", F.lit(4))
    index = stored(spark, _blocks(placed.join(sizes, "part"), F.pmod(salt, F.col("_n")), "ids", "vecs", "split"), "ann-index")
    groups = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    m, probes = len(router.p["bb"]), router.probes
    while True:
        ask = _blocks(_routed(queries, router, probes), F.pmod(salt, F.lit(groups)), "q_ids", "q_vecs", "q_block")
        lane = F.pmod(F.xxhash64("part", "split"), F.lit(LANES)).alias("lane")
        pairs = index.join(ask, "part").repartition("q_block", lane)
        best = pairs.select("q_ids", "q_vecs", "ids", "vecs").mapInPandas(_search_blocks(k), schema)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = stored(spark, best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                       .select("query_id", "rank", "vec_id", "score"), "ann-found")
        if probes == m or recall_at_k(rows, queries, found, k) >= AIM:
            return found
        probes = min(m, probes + max(1, m // 6))


def op9_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % EVERY == 0))
