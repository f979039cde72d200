"""Fitting the numpy classifiers on every labelled row, and a small optimiser for them.

The labelled rows outside the held-out fold are stored once and dealt by hash to the rounds of a fit, and in a round to
shards of a bounded number of bytes.  A task takes the model as it stands, descends over all rows of its shard in
small batches, and sends back how far it moved; the mean of the moves, taken block by block in two levels, is
the next model.  Every row takes part, in one round, so that its text is dealt once.  What the driver holds is one
model and the counts of the classes.  Moves are added in the order of the shards, so that a fit does not depend
on the tasks' order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import enter, held_out, stored

#: Text of a shard: about SHARD_BYTES, or SMALL_SHARD_BYTES while that makes no more than FEW_SHARDS.
SHARD_BYTES, SMALL_SHARD_BYTES, FEW_SHARDS = 16 << 20, 4 << 20, 24
#: Rounds of a fit on several shards, numbers in a block of a move, and shards whose moves are added first.
ROUNDS, BLOCK, NEAR = 2, 1 << 16, 32
#: Bounds of `training_sample`: rows and bytes of each class, and the length of the random span that stands for a
#: longer text.
SAMPLE_PER_CLASS = 3000
SAMPLE_BYTES = 24 << 20
SPAN_CHARS = 200_000


def training_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text",
                    per_class: int = SAMPLE_PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of a fixed random sample of the labelled rows outside the held-out fold, for a look at them on
    the driver.  No query is fitted on it: see `Examples`.

    Rows are taken in the order of a hash of their id, up to `per_class` rows and `most_bytes` of each
    class (one row at least), whatever their length: texts are whole, but for a random span of those beyond
    SPAN_CHARS characters.  A document with contradictory labels counts as labelled 1; of rows that
    repeat an id one is taken.  Rows with null ids, texts or labels and empty texts are no examples.
    """
    key = known_labels(labels, label, id_col)
    chars, at = F.length("_text"), F.pmod(F.xxhash64("_id", F.lit(9)), F.greatest(F.length("_text") - SPAN_CHARS + 1, F.lit(1)))
    text = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.length("_text") > 0) \
        .withColumn("_text", F.when(chars > SPAN_CHARS, F.substring("_text", (at + 1).cast("int"), F.lit(SPAN_CHARS))).otherwise(F.col("_text")))
    # the ids are drawn first: a rate by class, so that no task orders more than a bounded number of rows, then the
    # first in the order of the hash; they are few, so that the texts are found without a shuffle
    sizes = text.groupBy("_id").agg(F.max(F.octet_length("_text")).alias("_n"))
    pool = key.join(sizes, "_id").withColumn("_h", F.xxhash64("_id", F.lit(5)))
    counts = {r["_y"]: r["count"] for r in pool.groupBy("_y").count().collect()}
    drawn = []
    for y in (0, 1):
        rate = min(1.0, 2.0 * per_class / max(counts.get(y, 0), 1))
        some = pool.where(F.col("_y") == y) if rate == 1.0 else pool.where(
            (F.col("_y") == y) & (F.pmod("_h", F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))))
        rows = some.orderBy("_h", "_id").limit(per_class).toPandas()
        drawn.append(rows[(rows["_n"].cumsum() <= most_bytes) | (np.arange(len(rows)) == 0)][["_id", "_y"]])
    drawn = pd.concat(drawn)
    if not len(drawn):
        return [], np.zeros(0, int)
    want = docs.sparkSession.createDataFrame(drawn, "_id long, _y int")
    found = text.join(F.broadcast(want), "_id").toPandas().sort_values(["_id", "_text"]).drop_duplicates("_id")
    return found["_text"].tolist(), found["_y"].to_numpy()


def known_labels(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """(_id, _y) of the labelled ids outside the held-out fold; contradictory labels count as 1."""
    return labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")) \
        .where("_id is not null and _y is not null").where(~held_out(F.col("_id"))) \
        .groupBy("_id").agg(F.max("_y").alias("_y"))


@dataclass
class Examples:
    """Every labelled row outside the held-out fold: rows(_id, _y, _text, _h), stored, and counts of them."""

    rows: DataFrame
    counts: dict[int, int]
    n_bytes: int

    @classmethod
    def of(cls, docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text") -> "Examples":
        """Whole texts of every length; rows that repeat an id are examples each.  Rows with null ids, texts or labels
        and empty texts are none.  The labels are stored and merged with the texts, so that AQE splits a repeated id."""
        spark = docs.sparkSession
        known = stored(spark, known_labels(labels, label, id_col), "labels")
        texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")) \
            .where(F.length("_text") > 0).where(~held_out(F.col("_id")))
        rows = stored(spark, texts.join(known.hint("merge"), "_id").withColumn("_h", F.xxhash64("_id", "_text", F.lit(5))), "examples")
        found = rows.groupBy("_y").agg(F.count("*").alias("n"), F.sum(F.octet_length("_text")).alias("b")).collect()
        return cls(rows, {r["_y"]: r["n"] for r in found}, sum(r["b"] for r in found))

    @property
    def only_label(self) -> int | None:
        """The label of all rows, if they have but one."""
        return next(iter(self.counts)) if len(self.counts) == 1 else None

    def shards(self) -> int:
        """Shards of all rounds together."""
        return max(1, -(-self.n_bytes // SHARD_BYTES), min(-(-self.n_bytes // SMALL_SHARD_BYTES), FEW_SHARDS))


def fit_on_all(net, examples: Examples, train: Column | None = None):
    """Fits `net` on all rows of `examples` (those where `train` holds) and returns it.

    A network has `state()`, a dict of float arrays that can be changed in place; `sparse`, the names of
    those whose rows are averaged over the shards that moved them; and `learn(texts, y, share)`, which
    descends over the texts in the given order; `share` is the portion of label 1 in all rows.
    """
    rows = examples.rows if train is None else examples.rows.where(train)
    rounds = min(ROUNDS, examples.shards())
    shards = -(-examples.shards() // rounds)
    share = examples.counts.get(1, 0) / max(sum(examples.counts.values()), 1)
    for turn in range(rounds):
        dealt = rows.where(F.pmod(F.xxhash64("_h", F.lit(12)), F.lit(rounds)) == turn).select(
            F.pmod(F.xxhash64("_h", F.lit(11)), F.lit(shards)).cast("int").alias("_shard"), "_h", "_y", "_text")
        _move(net, _moves(dealt, net, shards, share))
    return net


def _moves(dealt: DataFrame, net, shards: int, share: float) -> list[tuple[int, np.ndarray]]:
    """(block, sum of the shards' moves) of one round."""
    def learnt(t: pa.Table) -> pa.Table:
        import copy

        enter("fit")
        t = t.sort_by([("_h", "ascending"), ("_text", "ascending")])
        own, number = copy.deepcopy(net), t.column("_shard")[0].as_py()
        before = {k: v.copy() for k, v in own.state().items()}
        own.learn(t.column("_text").combine_chunks(), t.column("_y").to_numpy(), share)
        flat = []
        for k, v in sorted(own.state().items()):
            moved = v - before[k]
            flat.append(moved.ravel())
            flat.append((moved != 0).any(axis=1) if k in own.sparse else np.ones(1))
        flat = np.concatenate(flat).astype(np.float32)
        cuts = range(0, len(flat), BLOCK)
        return pa.table({"block": pa.array(range(len(cuts)), pa.int32()), "shard": pa.array([number] * len(cuts), pa.int32()),
                         "move": pa.array([flat[a:a + BLOCK].tobytes() for a in cuts], pa.binary())})

    def added(t: pa.Table) -> pa.Table:
        t = t.sort_by("shard")
        total = sum(np.frombuffer(m, np.float32).astype(np.float64) for m in t.column("move").to_pylist())
        return pa.table({"block": t.column("block")[:1], "shard": t.column("shard")[:1],
                         "move": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    kind = "block int, shard int, move binary"
    # more partitions than shards, so that few hold two of them
    moves = dealt.repartition(3 * shards, "_shard").groupBy("_shard").applyInArrow(learnt, kind)
    near = moves.groupBy("block", (F.col("shard") / NEAR).cast("int").alias("near")).applyInArrow(added, kind)
    found = near.groupBy("block").applyInArrow(added, kind).select("block", "move").collect()
    return sorted((r["block"], np.frombuffer(r["move"], np.float32)) for r in found)


def _move(net, moves: list[tuple[int, np.ndarray]]) -> None:
    """Adds the mean move to the state of `net`."""
    if not moves:
        return
    flat, at = np.concatenate([m for _, m in moves]), 0
    for k, v in sorted(net.state().items()):
        moved = flat[at:at + v.size].reshape(v.shape)
        at += v.size
        n = v.shape[0] if k in net.sparse else 1
        by = np.maximum(flat[at:at + n], 1)
        at += n
        v += moved / (by[:, None] if k in net.sparse else by)


class Adam:
    """Adam over a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
