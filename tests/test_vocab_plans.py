"""The inlined and the joined vocabulary plan give the same rows, at any vocabulary size."""

import duckdb
import pytest
from pyspark.sql import functions as F

from parlance.functions.text import tokenize
from parlance.operators import augment as AU
from parlance.operators import tagger as TG
from parlance.operators import vocab as V
from parlance.plans import catalog as C
from parlance.sources.config import ActionConfig
from parlance.sources.corpus import load_corpus
from tools.check_oracle import TABLES, rows_of

SF_SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["token_types", "delexicalize", "slot_phrases", "augment_corpus", "act_correct_long",
                                  "act_multiturn", "act_selfcheck", "tag_disfluencies", "count_corrections"])
def test_joined_plan_matches_oracle(spark, monkeypatch, name):
    """With nothing inlined, queries still give the oracle's rows."""
    monkeypatch.setattr(V, "INLINE_VALUES", 0)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = C.QUERIES[name](spark, SF_SMALL)
    res = con.execute(C.ORACLE[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in res.description], res.fetchall())


def test_fifty_thousand_values(spark):
    """A large vocabulary: nothing is inlined, and all operators give the inlined plan's rows."""
    turns = spark.range(25_000).select(
        F.lit("trn").alias("split"), F.col("id").alias("dialogue_idx"), F.lit("d").alias("dialogue_id"),
        F.explode(F.sequence(F.lit(0), F.lit(1))).alias("turn_idx")).select(
        "*", F.when(F.col("turn_idx") == 0, "user").otherwise("system").alias("agent"),
        F.when(F.col("turn_idx") == 0, F.concat_ws(" ", F.lit("a table in"), F.concat(F.lit("city"), "dialogue_idx"),
                                                   F.lit("with"), F.concat(F.lit("dish"), "dialogue_idx"), F.lit("food")))
        .otherwise(F.concat_ws(" ", F.lit("api_call"), F.concat(F.lit("city"), "dialogue_idx"),
                               F.concat(F.lit("dish"), "dialogue_idx"))).alias("text"))
    values = V.slot_values(turns)
    vocab = V.SlotVocabulary.build(values)
    assert not vocab.inlined and vocab.words.count() == 50_000
    marks = vocab.annotate(turns.select(tokenize("text").alias("t"), "agent"), "t")
    got = marks.where("agent = 'user'").select(F.array_join(V.delexicalized("t"), " ").alias("d")).distinct().collect()
    assert [r.d for r in got] == ["a table in <value> with <value> food"]
    phrases = V.slot_phrases(turns, vocab, delexicalize=True).collect()
    assert sorted(r.phrase for r in phrases) == ["<value>", "in <value>", "with <value> food"]
    prefixes = TG.phrase_prefixes(turns, vocab).collect()
    assert sorted((r.prefix, r.n_words) for r in prefixes) == [
        ("<value>", 1), ("in", 1), ("in <value>", 2), ("with", 1), ("with <value>", 2), ("with <value> food", 3)]
    cfg = C.single_action_config("correct")
    out = AU.augment_turns(turns, cfg, vocab).where("agent = 'user' and size(actions) > 0")
    n = 0
    for r in out.select("dialogue_idx", "text").limit(3000).collect():
        for w in r.text.split():
            if w.startswith(("city", "dish")) and w[4:] != str(r.dialogue_idx):
                n += 1
                assert 0 <= int(w[4:]) < 25_000
    assert n > 1000
    some = turns.where("dialogue_idx < 300")
    small = V.SlotVocabulary.build(V.slot_values(some), inline_values=10_000)
    large = V.SlotVocabulary.build(V.slot_values(some), inline_values=0)
    assert small.inlined and not large.inlined
    for c in (cfg, ActionConfig.preset("default")):
        a, b = (AU.augment_turns(some, c, v).select("dialogue_idx", "turn_idx", "text").collect() for v in (small, large))
        assert sorted(a) == sorted(b)


def test_confusables_exclude_the_word(spark):
    vocab = V.SlotVocabulary.build(V.slot_values(load_corpus(spark, SF_SMALL)))
    word = vocab.values[0]
    expected = sorted({v for p in vocab.positions[word] for v in vocab.by_pos[p]} - {word})
    n = len(expected)
    got = spark.range(n).select(vocab.wrong_value(F.lit(word), (F.col("id") + 0.5) / n).alias("c")).collect()
    assert [r.c for r in got] == expected


def odd_turns(spark):
    """Repeated rows, null keys, null and empty texts beside ordinary turns."""
    said = ["a cheap table in rome with italian food", "in paris please", "oh cheap cheap cheap", "hi", "", None, "<SILENCE>"]
    calls = [("trn", 9, "d", 7, "system", "api_call italian rome two cheap"), ("trn", 9, "d", 9, "system", "api_call french paris six moderate")]
    rows = [(s, d, "d", t, "user", x) for s in ("trn", None) for d in (1, None) for t in (0, 2, None) for x in said for _ in range(25)]
    return spark.createDataFrame(calls + rows, "split string, dialogue_idx long, dialogue_id string, turn_idx int, agent string, text string")


@pytest.mark.parametrize("action", ["correct", "correct_long_distance", "selfcheck", "multiturn_correct", "hesitate"])
def test_repeated_rows_and_null_keys(spark, action):
    turns = odd_turns(spark)
    values = V.slot_values(turns.where("text is not null"))
    cfg = C.single_action_config(action)
    if action == "multiturn_correct":  # its shifts need whole dialogues; the rewriting itself is compared
        turns = turns.where("split = 'trn' and dialogue_idx = 1 and turn_idx = 0").withColumn("turn_idx", F.lit(0)).limit(1).unionByName(
            turns.where("agent = 'system'"))
    rows = []
    for most in (10_000, 0):
        vocab = V.SlotVocabulary.build(values, inline_values=most)
        assert vocab.inlined == (most > 0)
        out = AU.augment_turns(turns, cfg, vocab, with_tags=True, select="agent")
        rows.append(sorted(str(tuple(r)) for r in out.collect()))
    assert rows[0] == rows[1]
    assert len(rows[0]) >= turns.count() and any("action='" + action in r for r in rows[0])


def test_hot_token_list_is_split(spark):
    """Most turns are one greeting: the join with the stored token lists is split by AQE."""
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
                                                 "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    turns = spark.range(300_000).select(F.when(F.col("id") % 10 > 0, "hello there my friend").otherwise(
        F.concat_ws(" ", F.lit("city"), F.col("id").cast("string"))).alias("text"), F.sha2(F.col("id").cast("string"), 256).alias("pay"))
    vocab = V.SlotVocabulary.build(spark.createDataFrame([(0, "friend"), (0, "7")], "slot_pos int, value string"), inline_values=0)
    try:
        for k, v in zip(keep, ("-1", "-1", "256k", "64k")):
            spark.conf.set(k, v)
        out = vocab.annotate(turns.withColumn("t", tokenize("text")), "t")
        out.write.format("noop").mode("overwrite").save()
        seen = out.agg(F.count("*").alias("n"), F.sum(F.size("_slot")).alias("s"), F.max("pay"))
        assert seen.collect()[0].n == 300_000
        assert "skew=true" in seen._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
