"""The folds on space-joined texts and on a table of the sampler's states, beside their plain forms."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from parlance.functions.text import tokenize
from parlance.operators import augment as AU
from parlance.operators import disfluency_stats as DS
from parlance.operators.vocab import SlotVocabulary
from parlance.sources.config import TOKEN_TYPES, ActionConfig, list_presets

VOCAB = SlotVocabulary(positions={"rome": [0], "paris": [0]}, by_pos={0: ["paris", "rome"]})


def one_action(action: str, template: str) -> ActionConfig:
    return ActionConfig("one", {}, {"NULL": 1, action: 1}, {t: {"NULL": 1, action: 1} for t in TOKEN_TYPES}, {"NULL": [], action: [template]})


def test_plain_texts_are_split_without_a_regular_expression(spark):
    texts = ["a b", " a  b ", "", " ", "a", "a\tb\n", "a b 　c", "café (x) a|b", "a \u0085", None, "a.b $1 \\s+"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", tokenize("t").alias("x"))
    assert {r.k: r.x for r in got.collect()} == {k: None if t is None else t.split() for k, t in enumerate(texts)}
    assert "CASE WHEN" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limits", [{}, {"GLOBAL": 0}, {"GLOBAL": 1}, {"GLOBAL": 5}, {"NULL": 3}, {"restart": 0, "hesitate": 1}])
def test_states_draw_what_counting_draws(spark, limits):
    rng = random.Random(7)
    for name in ["default", "g2018_pp_restarts_only", "ablation_all"]:
        base = ActionConfig.preset(name)
        cfg = ActionConfig("c", {**base.limits, **limits}, base.weights, base.masks, base.templates)
        table = AU._states(cfg)
        if limits in ({}, {"GLOBAL": 1}):
            assert table is not None
        edges = sorted({b for bs in (table[0] if table else []) for of in bs for b in of if b}) or ["80000000"]
        def digits():
            return f"{(int(rng.choice(edges), 16) - rng.randint(0, 1)) % (1 << 32):08x}" if rng.random() < 0.6 else f"{rng.getrandbits(32):08x}"
        rows = [([(rng.randrange(3), digits(), i) for i in range(rng.randrange(9))],) for _ in range(150)]
        df = spark.createDataFrame(rows, "e array<struct<t:int,d:string,i:int>>")
        for r in df.select(AU.sample_picks(cfg, F.col("e")).alias("a"), AU._counted_picks(cfg, F.col("e")).alias("b")).collect():
            assert r.a == r.b


def test_many_states_are_counted():
    base = ActionConfig.preset("default")
    assert all(AU._states(ActionConfig.preset(n)) is not None for n in list_presets())
    assert AU._states(ActionConfig("c", {"GLOBAL": 90}, base.weights, base.masks, base.templates)) is None


def rewritten(spark, cfg, text: str, at: int):
    toks = tokenize(F.lit(text))
    picks = F.array(F.struct(F.lit(at).alias("i"), F.lit(cfg.actions.index([a for a in cfg.actions if a != "NULL"][0])).alias("a")))
    return spark.range(1).select(AU.rewrite(cfg, VOCAB, toks, None, picks, [F.lit("k")]).alias("r")).first().r


def test_long_phrases_and_odd_templates(spark):
    far = one_action("correct_long_distance", "$incorrect_phrase sorry $correct_phrase")
    n = 3000
    r = rewritten(spark, far, "x " + "in " * n + "rome" + " food" * n + " foodie", n + 1)
    phrase = ["in"] * n + ["rome"] + ["food"] * n
    assert r.toks == ["x", *[w.replace("rome", "paris") for w in phrase], "sorry", *phrase, "foodie"] and len(r.tags) == len(r.toks)
    r = rewritten(spark, far, "main rome pricey", 1)
    assert r.toks == ["main", "paris", "sorry", "rome", "pricey"]
    for at, left in [(0, ["b", "c"]), (1, ["a", "c"]), (2, ["a", "b"])]:  # a template without words
        r = rewritten(spark, one_action("hesitate", " "), "a b c", at)
        assert r.toks == left and r.tags == ["<f/>"] * 2
    r = rewritten(spark, one_action("hesitate", "er.$token! $token"), "café 你好 z", 1)
    assert r.toks == ["café", "er.你好!", "你好", "z"] and r.tags == ["<f/>", "<e/>", "<f/>", "<f/>"]
    assert rewritten(spark, one_action("hesitate", " "), "a", 0).toks == []


def test_counts_with_and_without_a_trigger_word(spark):
    cfg = ActionConfig.preset("default")
    rows = [("user", "rome sorry paris"), ("user", "sorryrome"), ("user", None), ("user", "hello"), ("user", "rome sorry paris"), ("system", "no rome")]
    got = DS.count_disfluencies(spark.createDataFrame(rows, "agent string, text string"), cfg, VOCAB, "correct").first()
    # a trigger needs three tokens from its first word on
    assert (got.n_triggers, got.n_user_turns) == (0, 5)
    rows = [(a, t + " please" if t else t) for a, t in rows]
    got = DS.count_disfluencies(spark.createDataFrame(rows, "agent string, text string"), cfg, VOCAB, "correct").first()
    assert (got.n_triggers, got.n_turns, got.n_cases, got.n_user_turns) == (2, 2, 1, 5)
