"""Sequence windows over dialogues (F1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def context_windows(turns: DataFrame, k: int, key=("split", "dialogue_idx")) -> DataFrame:
    """per user turn, the last k utterances (including it) joined as encoder input and the next
    turn of the other side as decoder output; user turns without an answer give no pair.

    A window per dialogue: a dialogue's turns are one group.
    """
    w = Window.partitionBy(*key).orderBy("turn_idx")
    answer = F.when(F.col("agent") != "user", F.col("text"))
    return (turns
            .withColumn("encoder", F.array_join(F.collect_list("text").over(
                w.rowsBetween(-(k - 1), 0)), " "))
            .withColumn("decoder", F.first(answer, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
            .where((F.col("agent") == "user") & F.col("decoder").isNotNull()))
