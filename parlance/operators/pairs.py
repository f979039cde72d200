"""Pairing of two stored corpora (D1): by position, or by lineage where turns were inserted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["split", "dialogue_idx", "turn_idx"]


def zip_join(left: DataFrame, right: DataFrame, left_text: str = "augmented", right_text: str = "original",
             key: list[str] = KEY) -> DataFrame:
    """Turns of two corpora at the same position: key, agent, both texts, `unpaired`.

    A full outer join on the position; a position that only one corpus has is kept, with a null
    on the other side and `unpaired` true (the reference stops at the shorter one without notice).
    """
    a = left.select(*key, F.col("agent").alias("_la"), F.col("text").alias(left_text))
    b = right.select(*key, F.col("agent").alias("_ra"), F.col("text").alias(right_text))
    both = a.join(b, key, "full")
    return both.select(*key, F.coalesce("_ra", "_la").alias("agent"), left_text, right_text,
                       (F.col("_la").isNull() | F.col("_ra").isNull()).alias("unpaired"))


def user_pairs(pairs: DataFrame, original: str = "original") -> DataFrame:
    """Paired user turns whose original is not the silence marker."""
    return pairs.where((F.col("agent") == "user") & ~F.col("unpaired") & (F.lower(original) != "<silence>"))


def lineage_join(augmented: DataFrame, original: DataFrame, left_text: str = "augmented", right_text: str = "original") -> DataFrame:
    """Turns of an augmented corpus beside the turns they come from, also where correction turns (H4) moved the positions.

    The alignment is on (original position, rank among what was put in its place): rank 0 is the original's
    own rewriting, all others are `inserted` and have no original.  Every original turn is paired with
    its rewriting once (for each copy); one without, and an augmented turn of unknown origin, is `unpaired`.
    """
    rank = F.col("inserted_rank") if "inserted_rank" in augmented.columns else F.lit(0)
    copy = F.col("copy_no") if "copy_no" in augmented.columns else F.lit(0)
    a = augmented.select("split", "dialogue_idx", F.col("orig_turn_idx").alias("_place"), copy.alias("copy_no"), "turn_idx",
                         F.col("agent").alias("_la"), F.col("text").alias(left_text), (rank > 0).alias("inserted"))
    b = original.select("split", "dialogue_idx", F.col("turn_idx").alias("_place"), F.col("agent").alias("_ra"), F.col("text").alias("_rt"))
    both = a.join(b, ["split", "dialogue_idx", "_place"], "full")
    return both.select("split", "dialogue_idx", "copy_no", "turn_idx", F.col("_place").alias("orig_turn_idx"),
                       F.when(F.col("inserted"), F.col("_la")).otherwise(F.coalesce("_ra", "_la")).alias("agent"),
                       left_text, F.when(~F.coalesce("inserted", F.lit(False)), F.col("_rt")).alias(right_text),
                       F.coalesce("inserted", F.lit(False)).alias("inserted"),
                       (F.col("_la").isNull() | F.col("_ra").isNull()).alias("unpaired"))
