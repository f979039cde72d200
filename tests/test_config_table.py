"""Configurations as a table give the rows of one run for each configuration."""

import pytest
from pyspark.sql import functions as F

from parlance.operators import augment as AU
from parlance.operators import config_table as CT
from parlance.operators import vocab as V
from parlance.plans import catalog as C
from parlance.sources.config import ActionConfig, list_presets
from parlance.sources.corpus import load_corpus

SF = "/root/testdata/sf0.001"
COLS = ["split", "dialogue_idx", "copy_no", "turn_idx", "orig_turn_idx", "agent", "text", "selected", "n_tokens", "actions", "inserted"]


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def variant(k: int) -> ActionConfig:
    """Presets with other weights, limits and templates: placeholders inside words, several templates, none."""
    base = ActionConfig.preset(list_presets()[k % len(list_presets())])
    weights = {a: (w * (1 + k % 3) if a != "NULL" else 5 + k) for a, w in base.weights.items()}
    limits = {**base.limits, "GLOBAL": k % 4, "NULL": 1 << 20}
    templates = {**base.templates, "hesitate": ["uhm, $token...", "$token $token", "well"][:1 + k % 3]}
    if k % 5 == 0:
        templates["correct"] = ["$incorrect_value/$correct_value no $correct_value", ""]
    return ActionConfig(f"v{k}", limits, weights, base.masks, templates)


@pytest.mark.parametrize("inline", [10_000, 0])
def test_equals_one_run_for_each(spark, inline):
    turns = load_corpus(spark, SF).where("dialogue_idx < 120")
    turns = turns.unionByName(turns.where("dialogue_idx < 8"))  # repeated rows
    vocab = V.SlotVocabulary.build(V.slot_values(turns), inline_values=inline)
    cfgs = [ActionConfig.preset(n) for n in list_presets()] + [variant(k) for k in range(0, 12, 3)]
    cfgs = [c for c in cfgs if not c.can_fire("multiturn_correct")]
    cfgs = cfgs if inline else [c for c in cfgs if c.config_id in ("default", "g2018_pp_restarts_only", "v0", "v3")]
    got = CT.augment_by_table(turns, CT.config_table(spark, cfgs), vocab).select("config_id", *COLS).cache()
    assert {r.config_id for r in got.select("config_id").distinct().collect()} == {c.config_id for c in cfgs}
    for cfg in cfgs:
        one = AU.augment_turns(turns, cfg, vocab, token_types=cfg.token_types).select(*COLS)
        assert rows(got.where(F.col("config_id") == cfg.config_id).select(*COLS)) == rows(one), cfg.config_id
    got.unpersist()


def test_multi_turn_corrections(spark):
    turns = load_corpus(spark, SF).where("dialogue_idx < 300")
    vocab = V.SlotVocabulary.build(V.slot_values(turns))
    cfgs = [C.single_action_config("multiturn_correct"), C.single_action_config("hesitate")]
    got = CT.augment_by_table(turns, CT.config_table(spark, cfgs), vocab)
    one = AU.augment_turns(turns, cfgs[0], vocab)
    assert rows(got.where("config_id = 'only_multiturn_correct'").select(*COLS, "inserted_rank")) == rows(one.select(*COLS, "inserted_rank"))
    assert one.where("inserted_rank > 0").count() > 0


def test_fifty_configurations_are_one_scan(spark):
    turns = load_corpus(spark, SF)
    vocab = V.SlotVocabulary.build(V.slot_values(turns))
    cfgs = [variant(k) for k in range(50)]
    out = CT.augment_by_table(turns, CT.config_table(spark, cfgs), vocab).where("selected")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan and "Union" not in plan
    counts = {r.config_id: r["count"] for r in out.groupBy("config_id").count().collect()}
    assert len(counts) == 50 and len(set(counts.values())) == 1
    assert CT.augment_by_table(turns, CT.config_table(spark, []), vocab).count() == 0
