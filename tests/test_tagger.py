"""Tagger (F5) against hand-traced goldens."""

from pyspark.sql import functions as F

from parlance.operators.tagger import markers, phrase_prefixes, phrase_reach, tag_tokens, tag_utterances
from parlance.operators.vocab import SlotVocabulary, delexicalized
from parlance.sources.config import ActionConfig

PHRASES = [("for", "<value>", "people"), ("with", "<value>", "cuisine"), ("in", "<value>"), ("<value>",)]
VOCAB = SlotVocabulary(positions={"two": [2], "six": [2], "italian": [0], "spanish": [0], "rome": [1],
                                  "madrid": [1]},
                       by_pos={0: ["italian", "spanish"], 1: ["madrid", "rome"], 2: ["six", "two"]})

CASES = [
    ("for two people no for six people please",
     "<f/> <f/> <f/> <e/> <rm-2/><rpMid/> <f/> <rpEnd/> <f/>"),
    ("i want a place with italian oh no spanish cuisine",
     "<f/> <f/> <f/> <f/> <f/> <f/> <e/> <e/> <rm-3/><rpEndSub/> <f/>"),
    ("for two no rome rome please", None),  # loses a tag: 6 tokens, 5 tags
]


def test_tagger_goldens(spark):
    cfg = ActionConfig.preset("default")
    df = spark.createDataFrame([(u,) for u, _ in CASES], "u string")
    toks = F.split("u", " ")
    df = VOCAB.annotate(df.withColumn("t", toks), "t")
    prefixes = spark.createDataFrame([(" ".join(p[:k]), k) for p in PHRASES for k in range(1, len(p) + 1)], "prefix string, n_words int").distinct()
    df = df.withColumn("utterance", F.array_join(delexicalized("t"), " "))
    df = df.join(phrase_reach(df.select("utterance").distinct(), prefixes), "utterance")
    tags = tag_tokens(delexicalized("t"), markers(cfg), F.col("reach"))
    out = df.select("u", F.size(toks).alias("n"), tags.alias("tags")).collect()
    got = {r.u: (" ".join(r.tags) if len(r.tags) == r.n else None) for r in out}
    for u, expected in CASES:
        assert got[u] == expected, (u, got[u])


def test_a_hundred_thousand_phrases(spark):
    """Phrases of many words, far too many for a plan: every one is found again in its own utterance."""
    left = ["with", "for", "in", "a"]
    n = 110_000
    words = [F.element_at(F.array(*map(F.lit, left)), (F.shiftright("id", 2 * k).bitwiseAND(3) + 1).cast("int")) for k in range(9)]
    turns = spark.range(n).select(F.lit("trn").alias("split"), F.col("id").alias("dialogue_idx"), F.lit(0).alias("turn_idx"),
                                  F.concat_ws(" ", F.lit("please"), *words, F.lit("rome"), F.lit("food"), F.lit("now")).alias("text"))
    prefixes = phrase_prefixes(turns, VOCAB)
    whole = prefixes.where("n_words = 11")
    assert whole.count() == n and prefixes.where("n_words = 1").count() == 4
    some = turns.where("dialogue_idx % 100 = 0")
    reach = phrase_reach(some.select(F.regexp_replace("text", "rome", "<value>").alias("utterance")), prefixes)
    assert reach.count() == n // 100 and reach.where("reach[0] <> 0 or reach[1] <> 11 or reach[12] <> 0").count() == 0
    tagged = tag_utterances(some, "text", ActionConfig.preset("default"), VOCAB, prefixes)
    assert tagged.where("tags is null or tag_length_mismatch").count() == 0 and tagged.count() == n // 100
    plan = tagged._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


def test_odd_utterances(spark):
    cfg = ActionConfig.preset("default")
    rows = [(1, ""), (2, None), (3, "hi"), (3, "hi"), (4, "a " * 3000 + "rome"), (5, "in rome no in madrid")]
    df = spark.createDataFrame(rows, "n int, text string")
    out = tag_utterances(df, "text", cfg, VOCAB, phrase_prefixes(df, VOCAB))
    got = sorted((r.n, len(r.tags) if r.tags is not None else None) for r in out.collect())
    assert got[0] == (1, 0) and (3, 1) in got and got.count((3, 1)) == 2 and (4, 3001) in got and (5, 5) in got
    none = spark.createDataFrame([], "prefix string, n_words int")
    assert tag_utterances(df.where("n = 5"), "text", cfg, VOCAB, none).count() == 1
