"""Hand-traced goldens (FIXTURES.md) and properties of the operators."""

from pyspark.sql import functions as F

from parlance.operators import augment as AU
from parlance.operators.vocab import SlotVocabulary
from parlance.sources import dialogue_text as A
from parlance.sources.config import ActionConfig

SF_SMALL = "/root/testdata/sf0.001"

INPUT = "in a cheap price range in madrid please"
VOCAB = SlotVocabulary(positions={"cheap": [3], "moderate": [3], "madrid": [1], "rome": [1]},
                       by_pos={1: ["madrid", "rome"], 3: ["cheap", "moderate"]})


def _cfg(action: str, template: str) -> ActionConfig:
    d = ActionConfig.preset("g2018_pp_restarts_only" if action == "pp_restart" else "default")
    weights = {a: (10 if a == action else (30 if a == "NULL" else 0)) for a in d.weights}
    templates = {a: ([template] if a == action else t) for a, t in d.templates.items()}
    return ActionConfig(f"t_{action}", d.limits, weights, d.masks, templates)


def _apply(spark, action, template, idx, text=INPUT, with_tags=False):
    cfg = _cfg(action, template)
    k = cfg.actions.index(action)
    df = spark.createDataFrame([(text,)], "text string")
    toks = F.split("text", " ")
    picks = F.array(F.struct(F.lit(idx).alias("i"), F.lit(k).alias("a")))
    keys = [F.lit(1), F.lit("t"), F.lit("s"), F.lit(0), F.lit(0), F.lit(0)]
    from parlance.functions.text import closed_class_pos
    rw = AU.rewrite(cfg, VOCAB, toks, closed_class_pos(toks), picks, keys, with_tags)
    r = df.select(F.array_join(rw["toks"], " ").alias("t"), rw["tags"].alias("g")).first()
    return r.t, (" ".join(r.g) if r.g is not None else None)


ACTION_GOLDENS = [
    ("hesitate", "uhm $token", 6, "in a cheap price range in uhm madrid please"),
    ("correct", "$incorrect_value no $correct_value", 6, "in a cheap price range in rome no madrid please"),
    ("correct_long_distance", "$incorrect_phrase sorry $correct_phrase", 6,
     "in a cheap price range in rome sorry in madrid please"),
    ("restart", "$token uhm yeah $utterance_from_beginning", 2,
     "in a cheap uhm yeah in a cheap price range in madrid please"),
    ("selfcheck", "let me see $token", 6, "in a cheap price range in let me see madrid please"),
    ("pp_restart", "$pp um $pp", 0, "in a um in a cheap price range in madrid please"),
]


def test_action_goldens(spark):
    for action, template, idx, expected in ACTION_GOLDENS:
        got, _ = _apply(spark, action, template, idx)
        assert got == expected, (action, got)


def test_inline_tag_goldens(spark):
    assert _apply(spark, "hesitate", "um like $token", 6, with_tags=True)[1].split()[6:9] == \
        ["<e/>", "<e/>", "<f/>"]
    _, tags = _apply(spark, "restart", "$token um $utterance_from_beginning", 0, "hi there", True)
    assert tags.split()[:3] == ["<f/>", "<e/>", "<rm-2/><rpEndSub/>"]
    _, tags = _apply(spark, "restart", "$token um $utterance_from_beginning", 2, "a b c d", True)
    assert tags.split() == ["<f/>", "<f/>", "<f/>", "<e/>", "<rm-4/><rpMid/>", "<f/>", "<rpEndSub/>", "<f/>"]
    _, tags = _apply(spark, "pp_restart", "$pp um $pp", 0, "in a cheap", True)
    assert tags.split()[:6] == ["<f/>", "<f/>", "<e/>", "<rm-3/><rpMid/>", "<rpEndSub/>", "<f/>"]


def test_first_token_probabilities():
    cfg = ActionConfig.preset("default")
    bg, sv = cfg.probabilities("background_word"), cfg.probabilities("slot_value")
    assert abs(bg["NULL"] - 30 / 32) < 1e-12 and abs(bg["restart"] - 2 / 32) < 1e-12
    assert abs(sv["NULL"] - 30 / 57) < 1e-12 and abs(sv["correct"] - 10 / 57) < 1e-12
    assert abs(sv["hesitate"] - 5 / 57) < 1e-12 and abs(sv["restart"] - 2 / 57) < 1e-12
    spent = cfg.probabilities("slot_value", {"correct": 1, "hesitate": 1})
    assert spent["NULL"] == 1.0


def test_first_token_probabilities_of_the_pp_restart_preset():
    cfg = ActionConfig.preset("g2018_pp_restarts_only")
    assert cfg.token_types == "three" and ActionConfig.preset("default").token_types == "two"
    pp = cfg.probabilities("pp_start")
    assert abs(pp["pp_restart"] - 10 / 40) < 1e-12 and abs(pp["NULL"] - 30 / 40) < 1e-12
    assert cfg.probabilities("background_word")["NULL"] == cfg.probabilities("slot_value")["NULL"] == 1.0


def test_two_corrections_in_one_utterance(spark):
    """Picks are applied from right to left, so the left one keeps its place."""
    cfg = _cfg("correct", "$incorrect_value no $correct_value")
    k = cfg.actions.index("correct")
    df = spark.createDataFrame([("a cheap place in madrid please",)], "text string")
    toks = F.split("text", " ")
    picks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("a")) for i in (1, 4)])
    from parlance.functions.text import closed_class_pos
    rw = AU.rewrite(cfg, VOCAB, toks, closed_class_pos(toks), picks, [F.lit(x) for x in (1, "t", "s", 0, 0, 0)], True)
    r = df.select(F.array_join(rw["toks"], " ").alias("t"), F.array_join(rw["tags"], " ").alias("g")).first()
    assert r.t == "a moderate no cheap place in rome no madrid please"
    assert r.g == "<f/> <f/> <e/> <f/> <f/> <f/> <f/> <e/> <f/> <f/>"


def test_correction_turns_shift_the_dialogue(spark):
    """H4: [U1(2 corrections), S1, U2(1), S2 last] -> S1 C2 S1 C1 S1, then U2, S2 C S2."""
    rows = [("s", 1, 0, t, "user" if t % 2 == 0 else "system", x, ins) for t, x, ins in [
        (0, "u1", ["c1", "c2"]), (1, "s1", []), (2, "u2", ["c3"]), (3, "s2", [])]]
    df = spark.createDataFrame(rows, "split string, dialogue_idx long, copy_no int, orig_turn_idx int, agent string, "
                                     "text string, inserted array<string>").withColumn("turn_idx", F.col("orig_turn_idx"))
    got = [(r.turn_idx, r.agent, r.text) for r in AU._insert_correction_turns(df).orderBy("turn_idx").collect()]
    assert got == [(0, "user", "u1"), (1, "system", "s1"), (2, "usr", "c2"), (3, "system", "s1"), (4, "usr", "c1"),
                   (5, "system", "s1"), (6, "user", "u2"), (7, "system", "s2"), (8, "usr", "c3"), (9, "system", "s2")]
    last = df.where("orig_turn_idx < 3")
    assert AU._insert_correction_turns(last).where("agent = 'usr'").count() == 2     # none after the last turn


def test_parse_golden(spark, tmp_path):
    lines = ["1 hi\thello", "2 <SILENCE>\tapi_call a b", "", "", "1 yo\tok", "3 kb row no tab", "", ""]
    (tmp_path / "file").write_text("\n".join(lines))
    parsed = A.parse_dialogue_records(A.read_dialogue_records(spark, str(tmp_path / "file")))
    got = sorted((r.dialogue_id, r.turn_idx, r.agent, r.text) for r in parsed.collect())
    assert got == [("file.1", 0, "user", "hi"), ("file.1", 1, "system", "hello"),
                   ("file.1", 2, "user", "<SILENCE>"), ("file.1", 3, "system", "api_call a b"),
                   ("file.2", 0, "user", "yo"), ("file.2", 1, "system", "ok"),
                   ("file.2", 2, "system", "kb row no tab")]


def test_read_dialogue_files(spark, tmp_path):
    p = tmp_path / "dialog-task1-dev.txt"
    p.write_text("1 hi\thello\n2 <SILENCE>\tapi_call a b\n\n\n1 yo\tok\n3 kb row no tab\n\n\n")
    t = A.read_dialogues(spark, str(p))
    rows = sorted((r.split, r.dialogue_no, r.turn_idx, r.text) for r in t.collect())
    assert rows[0] == ("dev", 1, 0, "hi") and rows[-1] == ("dev", 2, 2, "kb row no tab")
    assert len(rows) == 7


def test_augmentation_is_partitioning_invariant(spark):
    from parlance.plans import catalog as C
    base = C.fx(spark, SF_SMALL)
    a = C.QUERIES["augment_corpus"](spark, SF_SMALL)
    b = C._aug(spark, SF_SMALL, ActionConfig.preset("default"), turns=base.repartition(7)).select(
        "split", "dialogue_idx", "copy_no", "turn_idx", "agent", "text")
    assert sorted(a.collect()) == sorted(b.collect())


def test_limits_hold_and_spans_remove_cleanly(spark):
    from parlance.plans import catalog as C
    audit = {r.action: (r.max_count, r.action_limit) for r in C.QUERIES["limit_audit"](spark, SF_SMALL).collect()}
    assert all(m <= lim for m, lim in audit.values())
    # hesitations only insert marker words: removing them gives the original back
    h = C.QUERIES["act_hesitate"](spark, SF_SMALL).join(
        C.fx(spark, SF_SMALL).select("split", "dialogue_idx", "turn_idx", F.col("text").alias("orig")),
        ["split", "dialogue_idx", "turn_idx"])
    for r in h.collect():
        toks = [t for t in r.text.split() if t not in ("uhm", "well")]
        assert " ".join(toks) == " ".join(w for w in r.orig.split() if w not in ("uhm", "well"))
