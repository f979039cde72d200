"""Corpus statistics: shape, unique answers, text frequencies and their percentile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import is_api_call, tokenize
from ..session import scratch_path


def corpus_stats(turns: DataFrame, by: str = "split") -> DataFrame:
    """#dialogues, mean turns per dialogue, mean words per system / user turn."""
    n = F.size(tokenize("text"))
    sys_, usr = F.col("agent") == "system", F.col("agent") == "user"
    g = turns.groupBy(by).agg(
        F.countDistinct("dialogue_idx").alias("n_dialogues"),
        F.count(F.lit(1)).alias("n_turns"),
        F.sum(F.when(sys_, n)).alias("_sys_words"),
        F.count(F.when(sys_, 1)).alias("_sys_turns"),
        F.sum(F.when(usr, n)).alias("_usr_words"),
        F.count(F.when(usr, 1)).alias("_usr_turns"),
    )
    return g.select(
        by, "n_dialogues",
        (F.col("n_turns").cast("double") / F.col("n_dialogues")).alias("mean_turns"),
        (F.col("_sys_words").cast("double") / F.col("_sys_turns")).alias("mean_system_words"),
        (F.col("_usr_words").cast("double") / F.col("_usr_turns")).alias("mean_user_words"),
    )


def answer_stats(turns: DataFrame) -> DataFrame:
    """E5: distinct system answers, api-call vs interlocutory, per split and overall ('all')."""
    sys_ = turns.where(F.col("agent") == "system").select("split", "text").distinct()

    def agg(df):
        call = is_api_call("text")
        return df.agg(F.count(F.when(~call, 1)).alias("n_interlocutory"), F.count(F.when(call, 1)).alias("n_api_calls"))

    per_split = agg(sys_.groupBy("split"))
    overall = agg(sys_.select("text").distinct()).select(F.lit("all").alias("split"), "*")
    return per_split.unionByName(overall)


def text_frequency(turns: DataFrame, agent: str = "user", by: str = "split") -> DataFrame:
    """Frequency of each distinct text of one agent (partial aggregation absorbs hot texts)."""
    return (turns.where(F.col("agent") == agent).groupBy(by, "text")
            .agg(F.count(F.lit(1)).alias("freq")))


def frequency_percentile(freq: DataFrame, q: float = 0.95, by: str = "split") -> DataFrame:
    """Exact linear-interpolation percentile of `freq` per group, from its histogram.

    Collecting every frequency of a group into one task would not scale; the histogram
    (freq -> number of texts) has few rows, and the two order statistics around
    position (n-1)·q are read off its cumulative counts.
    """
    hist = freq.groupBy(by, "freq").agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy(by).orderBy("freq")
    h = (hist.withColumn("cum", F.sum("cnt").over(w))
         .withColumn("n", F.sum("cnt").over(Window.partitionBy(by))))
    pos = (F.col("n") - 1).cast("double") * F.lit(q)
    h = h.withColumn("lo_r", F.floor(pos)).withColumn("hi_r", F.ceil(pos)).withColumn(
        "frac", pos - F.floor(pos))
    # value at 0-based rank r = smallest freq whose cumulative count exceeds r
    g = h.groupBy(by).agg(
        F.min(F.when(F.col("cum") > F.col("lo_r"), F.col("freq"))).alias("v_lo"),
        F.min(F.when(F.col("cum") > F.col("hi_r"), F.col("freq"))).alias("v_hi"),
        F.first("frac").alias("frac"),
    )
    thr = F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac")
    return g.select(by, thr.cast("double").alias("threshold"))


def infrequent_turns(turns: DataFrame, agent: str = "user", q: float = 0.95,
                     by: str = "split") -> DataFrame:
    """Turns of `agent` whose text frequency is strictly below the group's percentile.

    The frequent side (freq >= threshold) is the top tail of distinct texts.  It is stored: its size is then
    known when the anti-join is planned, so that it is broadcast where it is small; where it is not, both
    sides are plain shuffles and AQE splits a hot text's partition, which one task would have to sort else.
    """
    freq = text_frequency(turns, agent, by)
    thr = frequency_percentile(freq, q, by)
    path = scratch_path(turns.sparkSession, "frequent-texts")
    frequent = freq.join(thr, by).where(F.col("freq") >= F.col("threshold")).select(by, "text")
    frequent.write.parquet(path)
    frequent = turns.sparkSession.read.schema(frequent.schema).parquet(path)
    return turns.where(F.col("agent") == agent).join(frequent, [by, "text"], "left_anti")


def unseen_api_calls(turns: DataFrame, test_split: str = "tst", train_split: str = "trn"
                     ) -> DataFrame:
    """Distinct api-call answers of the test split absent from the train split."""
    calls = turns.where((F.col("agent") == "system") & is_api_call("text"))
    test = calls.where(F.col("split") == test_split).select("text").distinct()
    train = calls.where(F.col("split") == train_split).select("text").distinct()  # few texts make up most rows
    return test.join(train, "text", "left_anti")
