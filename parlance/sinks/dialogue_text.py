"""Dialogue writers (B1-B6): tab-separated dialogue files, babble lines, datasets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

DIALOGUE_KEY = ["split", "dialogue_idx"]


def _sorted_turns(turns: DataFrame, key: list[str], *extra: Column) -> DataFrame:
    """One row per dialogue with its turns sorted (a dialogue is a small, bounded group)."""
    return turns.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("turn_idx", "agent", "text"))).alias("turns"), *extra)


def render_dialogues(turns: DataFrame, key: list[str] = DIALOGUE_KEY, extra: Sequence[Column] = ()) -> DataFrame:
    """B1: `k user<TAB>system` lines per dialogue (pairs (0,1), (2,3), …), k from 1.

    Dialogues with an odd number of turns cannot be paired; they get `text` NULL and
    `odd_turns` true (the reference asserts instead).  `extra` aggregates go along.
    """
    g = _sorted_turns(turns, key, *extra)
    n = F.size("turns")
    lines = F.transform(
        F.sequence(F.lit(0), (n / 2).cast("int") - 1),
        lambda k: F.format_string("%d %s\t%s", k + 1, F.col("turns")[2 * k]["text"],
                                  F.col("turns")[2 * k + 1]["text"]))
    even = n % 2 == 0
    more = [c for c in g.columns if c not in (*key, "turns")]
    return g.select(*key, F.when(even & (n > 0), F.array_join(lines, "\n")).alias("text"),
                    (~even).alias("odd_turns"), *more)


def render_babble(turns: DataFrame, key: list[str] = DIALOGUE_KEY) -> DataFrame:
    """`agent:<TAB>text` per turn, one block per dialogue."""
    g = _sorted_turns(turns, key)
    return g.select(*key, F.array_join(F.transform(
        "turns", lambda t: F.format_string("%s:\t%s", t["agent"], t["text"])), "\n").alias("text"))


def write_dialogue_text(turns: DataFrame, path: str, key: list[str] = DIALOGUE_KEY, extra: Sequence[Column] = (),
                        watch: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """B1/B8 to files: one folder per split, dialogues in order, two blank lines after each; what was in `path` goes.

    Turns are dealt by ranges of (split, dialogue); a range holds whole dialogues, so grouping, sorting
    and writing need no other shuffle.  `watch` sees the rendered dialogues as they are written.
    """
    r = watch(render_dialogues(turns.repartitionByRange(*key), key, extra)).where(F.col("text").isNotNull())
    (r.sortWithinPartitions(*key).select("split", F.concat("text", F.lit("\n\n")).alias("value"))
     .write.mode("overwrite").partitionBy("split").text(path))


def write_dialogue_files(dialogues: DataFrame, path: str) -> None:
    """One file per dialogue (name, text): `path/name=<name>/…`, as `read_dialogue_files` lists them."""
    tasks = dialogues.sparkSession.sparkContext.defaultParallelism  # small files: their number counts, not their bytes
    dialogues.select("name", F.col("text").alias("value")).repartition(tasks, "name").write.mode("overwrite").partitionBy("name").text(path)


def write_permutation(permutation: DataFrame, path: str, separator: str = ";") -> None:
    """A permutation (rank, dialogue_ord) as one line of integers; the part files in the order of their names are
    consecutive pieces of the line, each number followed by the separator."""
    (permutation.repartitionByRange("rank").sortWithinPartitions("rank").select(F.col("dialogue_ord").cast("string").alias("value"))
     .write.mode("overwrite").option("lineSep", separator).text(path))


# Fixed value: the header of the parallel file.
PARALLEL_HEADER = ("babi_plus", "babi")


def write_parallel_csv(pairs: DataFrame, path: str) -> None:
    """(augmented, original) as a two-column CSV with its header (quoting kept on: `;` inside
    text stays safe)."""
    (pairs.select(F.col("augmented").alias(PARALLEL_HEADER[0]), F.col("original").alias(PARALLEL_HEADER[1]))
     .write.mode("overwrite").option("sep", ";").option("escape", '"').option("header", True).csv(path))


def write_pair_files(pairs: DataFrame, path: str, order: list[str]) -> None:
    """`path/encoder` and `path/decoder`, two folders of text files aligned line by line.

    The rows are sorted once into a stored table, one file per range; both sides are written from
    its files, so part k of one side matches part k of the other.
    """
    spark = pairs.sparkSession
    tmp = scratch_path(spark, "pairs")
    one_line = lambda c: F.regexp_replace(c, "[\\r\\n]+", " ")
    (pairs.select(*order, one_line("encoder").alias("encoder"), one_line("decoder").alias("decoder"))
     .repartitionByRange(*order).sortWithinPartitions(*order)
     .withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(tmp))
    rows = spark.read.parquet(tmp)
    for side in ("encoder", "decoder"):
        (rows.repartition("part").sortWithinPartitions("part", *order)
         .select("part", F.col(side).alias("value")).write.mode("overwrite").partitionBy("part").text(f"{path}/{side}"))


def write_dataset_files(pairs: DataFrame, path: str, dataset: str, order: list[str]) -> list[str]:
    """B5 for several datasets (train, dev, test; or splits): pair files under `path/<dataset>`; returns the names.

    The names are few (a column of dataset names); each dataset is one write of its own rows.
    """
    stored = scratch_path(pairs.sparkSession, "datasets")
    pairs.select(dataset, *order, "encoder", "decoder").write.partitionBy(dataset).parquet(stored)
    rows = pairs.sparkSession.read.parquet(stored)
    names = sorted(r[0] for r in rows.select(dataset).distinct().collect())
    for name in names:
        write_pair_files(rows.where(F.col(dataset) == name), f"{path}/{name}", order)
    return names


def write_tagged(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Tagged dataset (utterance, tags[, pos]) as Parquet or JSON Lines."""
    w = df.write.mode("overwrite")
    (w.parquet(path) if fmt == "parquet" else w.json(path))
