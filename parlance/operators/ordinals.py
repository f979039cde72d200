"""Positions, permutations, splits and oversampling.

A global `row_number()` without PARTITION BY runs in a single task, and one per split puts a
whole (possibly huge) split in one task.  `ordinal_within` computes the same 0-based positions
in two distributed passes: a range-partitioned sort (a hot group is spread over many
partitions), then per-partition counts whose prefix sums give each partition's offset.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import let
from ..sources.corpus import split_rank


def ordinal_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
                   out: str = "ordinal") -> DataFrame:
    """0-based position of each row within its group by `order_cols` (unique within a group).

    Pass 1: range-partition and sort on (group, order); `monotonically_increasing_id` then
    increases along the global order and is consecutive inside a partition.  The result is
    checkpointed (to the cluster's checkpoint folder) so both uses below see identical ids.
    Pass 2: per (partition, group) count and first id, prefix sums over partitions, join back.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    keys = [F.col(c) for c in group_cols] + order
    tagged = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    pid = F.shiftright("_mid", 33)
    blocks = tagged.groupBy(pid.alias("_pid"), *group_cols).agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    w = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()).orderBy("_pid")
    blocks = blocks.withColumn("_off", F.sum("_cnt").over(w) - F.col("_cnt"))
    joined = tagged.withColumn("_pid", pid).join(
        blocks.select("_pid", *group_cols, "_off", "_first"), ["_pid", *group_cols])
    return joined.withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("bigint")
                             ).drop("_pid", "_off", "_first", "_mid")


def dialogues(turns: DataFrame) -> DataFrame:
    """Distinct dialogues (split, dialogue_idx)."""
    return turns.select("split", "dialogue_idx").distinct()


def dialogue_ordinals(turns: DataFrame) -> DataFrame:
    """A3: global 0-based ordinal of each dialogue over the splits concatenated in corpus order."""
    d = dialogues(turns).withColumn("_sr", split_rank(F.col("split")))
    return ordinal_within(d, [], ["_sr", "dialogue_idx"], "ordinal").drop("_sr")


def hashed_key(seed: int, *parts: Column | str) -> Column:
    cols = [F.lit(str(seed))] + [p.cast("string") if isinstance(p, Column) else F.col(p).cast("string")
                                 for p in parts]
    return F.md5(F.concat_ws("|", *cols))


class KeyedPermutation:
    """G1: a seeded bijection of [0, n), computed row by row in both directions: no sort, no shuffle, no stored table.

    A number is a pair (l, r) of the domain a x b with a = ceil(sqrt n), b = ceil(n / a).  A balanced
    network changes one half at a time by a hash of the other, which can be undone whatever the
    hash is.  The domain has less than sqrt(n) numbers too many: an image among them is mapped
    again until it is below n (the walk stays on one cycle, so this too is a bijection).
    """

    ROUNDS = 6
    WALK = 64  # a small domain has at most so many numbers too many; in a larger one so long a walk has probability < n^-32

    def __init__(self, n: int, seed: int = 273):
        self.n, self.seed = n, seed
        self.a = math.isqrt(n - 1) + 1 if n > 0 else 1
        self.b = -(-n // self.a) or 1
        self.steps = min(self.a * self.b - n + 1, self.WALK)

    def _digits(self, j: int, half: Column) -> Column:
        """Round j's function of a half: the first 32 bits of a digest."""
        h = F.md5(F.concat_ws("|", F.lit(str(self.seed)), F.lit(str(j)), half.cast("string")))
        return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")

    def _network(self, x: Column, undo: bool) -> Column:
        def round_(st: Column, j: int) -> Column:
            side, size = ("l", self.a) if j % 2 == 0 else ("r", self.b)
            other = st["r"] if side == "l" else st["l"]
            new = F.pmod(st[side] - self._digits(j, other) if undo else st[side] + self._digits(j, other), F.lit(size).cast("bigint"))
            return F.struct((new if side == "l" else st["l"]).alias("l"), (new if side == "r" else st["r"]).alias("r"))

        def chain(st: Column, rounds: list[int]) -> Column:
            return let(round_(st, rounds[0]), lambda t: chain(t, rounds[1:])) if rounds else st["r"] * self.a + st["l"]

        order = list(range(self.ROUNDS))
        halves = F.struct((x % self.a).alias("l"), F.floor(x / self.a).cast("bigint").alias("r"))
        return let(halves, lambda st: chain(st, order[::-1] if undo else order))

    def _walk(self, x: Column, undo: bool) -> Column:
        x = x.cast("bigint")
        if self.n <= 1:
            return x
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.steps)), x, lambda y, k: F.when(
            (k == 1) | (y >= self.n), self._network(y, undo)).otherwise(y))

    def at(self, rank: Column) -> Column:
        """The element at a position."""
        return self._walk(rank, undo=False)

    def rank_of(self, element: Column) -> Column:
        """The position of an element."""
        return self._walk(element, undo=True)


def corpus_permutation(turns: DataFrame, seed: int = 273) -> DataFrame:
    """G1: seeded permutation of the dialogue ordinals of a corpus: (rank, dialogue_ord)."""
    n = dialogues(turns).count()
    perm = KeyedPermutation(n, seed)
    return turns.sparkSession.range(n).select(F.col("id").alias("rank"), perm.at(F.col("id")).alias("dialogue_ord"))


#: Dialogue indices of one bucket, when dialogues are looked up by ordinal.
BUCKET = 1024


def dialogues_at(turns: DataFrame, wanted: DataFrame) -> DataFrame:
    """The dialogues at given ordinals (`dialogue_ord` and other columns of `wanted`): adds split, dialogue_idx.

    Ordinals count the dialogues of the splits in corpus order (`dialogue_ordinals`), but the corpus is
    not ranked: dialogues are counted per bucket of indices, prefix sums of the counts tell which
    buckets hold the wanted ordinals, and only the dialogues of those are ranked, at most BUCKET at a time.
    """
    d = dialogues(turns).select("split", "dialogue_idx", split_rank(F.col("split")).alias("_sr"),
                                F.floor(F.col("dialogue_idx") / BUCKET).alias("_bucket"))
    counts = d.groupBy("_sr", "split", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy("_sr", "split").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    splits = counts.groupBy("_sr", "split").agg(F.sum("_n").alias("_total"))
    earlier = Window.orderBy("_sr", "split").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    splits = splits.select("_sr", "split", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    firsts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(splits, ["_sr", "split"]).select(
        "split", "_bucket", (F.col("_base") + F.col("_before")).alias("_first"), "_n")
    chunk = lambda c: F.floor(c / BUCKET)
    parts = firsts.withColumn("_chunk", F.explode(F.sequence(chunk(F.col("_first")), chunk(F.col("_first") + F.col("_n") - 1))))
    hit = wanted.withColumn("_chunk", chunk(F.col("dialogue_ord"))).join(parts, "_chunk").where(
        (F.col("dialogue_ord") >= F.col("_first")) & (F.col("dialogue_ord") < F.col("_first") + F.col("_n"))).drop("_chunk", "_n")
    near = d.join(hit.select("split", "_bucket").distinct(), ["split", "_bucket"], "left_semi")
    place = F.row_number().over(Window.partitionBy("split", "_bucket").orderBy("dialogue_idx")) - 1
    ranked = near.select("split", "_bucket", "dialogue_idx", place.cast("bigint").alias("_place"))
    return hit.withColumn("_place", F.col("dialogue_ord") - F.col("_first")).join(ranked, ["split", "_bucket", "_place"]).drop(
        "_bucket", "_place", "_first")


def fold_sample(turns: DataFrame, fold: int = 4, size: int = 100, seed: int = 273) -> DataFrame:
    """The dialogues at positions [fold * size, (fold + 1) * size) of the corpus permutation:
    (rank, dialogue_ord, split, dialogue_idx)."""
    n = dialogues(turns).count()
    perm = KeyedPermutation(n, seed)
    ranks = turns.sparkSession.range(min(fold * size, n), min((fold + 1) * size, n))
    return dialogues_at(turns, ranks.select(F.col("id").alias("rank"), perm.at(F.col("id")).alias("dialogue_ord")))


def ratio_split(items: DataFrame, key_cols: Sequence[str], seed: int = 273, ratio: float = 0.8
                ) -> DataFrame:
    """Exact-size shuffle split: train = int(r*n), dev = int((n-train)/2), test = rest."""
    keyed = items.withColumn("_h", hashed_key(seed, *key_cols))
    ranked = ordinal_within(keyed, [], ["_h", *key_cols], "rank").drop("_h")
    n = ranked.count()  # of the checkpointed rows: the input is not computed again
    train = int(ratio * n)
    dev = int((n - train) / 2.0)
    part = (F.when(F.col("rank") < train, "train").when(F.col("rank") < train + dev, "dev")
            .otherwise("test"))
    return ranked.withColumn("part", part)


def oversample(turns: DataFrame, multiplier: int | None = None, extra_fraction: float | None = None
               ) -> DataFrame:
    """Cyclic oversampling of dialogues per split; adds `copy_no`.

    An integral `multiplier` k gives every dialogue copies 0..k-1 (narrow, no positions
    needed).  Otherwise the result size per split is N = len + floor(len * extra_fraction):
    dialogue at position p gets ceil((N - p) / len) copies, which needs positions.
    """
    if multiplier is not None:
        return turns.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(multiplier - 1))))
    plan = oversample_plan(turns, extra_fraction or 0.0)
    return turns.join(plan.select("split", "dialogue_idx", "copy_no"), ["split", "dialogue_idx"])


def oversample_plan(turns: DataFrame, extra_fraction: float) -> DataFrame:
    d = ordinal_within(dialogues(turns), ["split"], ["dialogue_idx"], "pos")
    sizes = d.groupBy("split").agg(F.count(F.lit(1)).alias("len"))
    d = d.join(sizes, "split")
    n_result = F.col("len") + F.floor(F.col("len") * F.lit(extra_fraction))
    copies = F.ceil((n_result - F.col("pos")) / F.col("len"))
    d = d.where(F.col("pos") < n_result).withColumn(
        "copy_no", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))))
    return d.select("split", "dialogue_idx", "copy_no",
                    (F.col("copy_no") * F.col("len") + F.col("pos")).alias("result_idx"))


def merge_parts(parts: DataFrame, group_cols: Sequence[str], start: str, line: str) -> DataFrame:
    """Partial outputs, keyed by integer start offset, as one ordered output per group: adds
    `part_no` (rank of the start) and `merged_pos` (position of the line in the merged output)."""
    starts = ordinal_within(parts.select(*group_cols, start).distinct(), group_cols, [start], "part_no")
    merged = ordinal_within(parts, group_cols, [start, line], "merged_pos")
    return merged.join(starts, [*group_cols, start]).drop(line)
