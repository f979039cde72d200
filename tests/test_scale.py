"""Steps that must not grow faster than their input: draws, stored corpus, report, counting job, infrequent turns."""

import pytest
from pyspark.sql import functions as F

from parlance.functions.rng import TWO_POW_32, least_digits
from parlance.operators import augment as AU
from parlance.operators import stats as S
from parlance.operators import vocab as V
from parlance.plans import catalog as C
from parlance.session import more_scan_tasks
from parlance.sources import corpus as CO
from parlance.sources.config import TOKEN_TYPES, ActionConfig, list_presets

SF = "/root/testdata/sf0.001"


def corpus(spark):
    lines = ["can you book a table in rome with thai cuisine for two people", "<SILENCE>", "", "in a cheap price range please", "rome"]
    rows = [("trn", d, f"trn.{d}", t, "user" if t % 2 == 0 else "system",
             "api_call thai rome two cheap" if d % 7 == 0 and t == 7 else "api_call food paris six moderate" if t == 7 else lines[(d + t) % 5])
            for d in range(60) for t in range(8)]
    return spark.createDataFrame(rows + rows[:16], "split string, dialogue_idx long, dialogue_id string, turn_idx int, agent string, text string")


@pytest.mark.parametrize("name", list_presets())
def test_bounds_of_the_draws(name):
    cfg = ActionConfig.preset(name)
    live = [a for a in cfg.actions if a == "NULL" or cfg.can_fire(a)]
    for t, digits in zip(TOKEN_TYPES, AU.firing_digits(cfg)):
        weights = [cfg.base_weight(t, a) if cfg.limit(a) > 0 else 0.0 for a in live]
        null = lambda n: weights[0] > sum(weights) * (n / TWO_POW_32)
        if digits is None:
            assert not any(weights[1:])
        else:
            assert not null(int(digits, 16)) and (int(digits, 16) == 0 or null(int(digits, 16) - 1))
    assert least_digits(lambda u: True) == "00000000" and least_digits(lambda u: False) is None


@pytest.mark.parametrize("limits", [{}, {"NULL": 3}, {"GLOBAL": 1}, {"GLOBAL": 1 << 20, "correct": 1}])
def test_tokens_left_out_change_nothing(spark, monkeypatch, limits):
    turns, base = corpus(spark), ActionConfig.preset("default")
    cfg = ActionConfig("few", {**base.limits, **limits}, base.weights, base.masks, base.templates)
    vocab = V.SlotVocabulary.build(V.slot_values(turns))
    drawn = []
    fold = AU.sample_picks
    monkeypatch.setattr(AU, "sample_picks", lambda cfg, elems: drawn.append(elems) or fold(cfg, elems))
    got = sorted(map(str, AU.augment_turns(turns, cfg, vocab).collect()))
    tokens, gone = turns.withColumn("copy_no", F.lit(0)).withColumn("_toks", F.split("text", " ")).where("turn_idx % 2 = 0 and text <> ''"), limits.get("NULL", 0)
    sizes = tokens.select(F.size("_toks").alias("n"), F.size(drawn[0]).alias("k")).where(f"n > {max(gone, 5)}").agg(F.sum("n"), F.sum("k")).first()
    assert sizes[1] == sizes[0] if gone else sizes[1] < 0.6 * sizes[0]
    monkeypatch.setattr(AU, "firing_digits", lambda cfg: None)
    assert got == sorted(map(str, AU.augment_turns(turns, cfg, vocab).collect()))


def test_stored_corpus_is_read_by_even_tasks(spark, monkeypatch):
    monkeypatch.setattr(CO, "_MATERIALIZED", {})
    monkeypatch.setattr(CO, "DIALOGUES_PER_FILE", 50)
    turns = CO.load_corpus(spark, SF)
    sizes = [r["count"] for r in turns.groupBy(F.input_file_name()).count().collect()]
    n = sum(sizes)
    assert len(sizes) >= 16 and max(sizes) < n / 8
    assert sorted(map(str, turns.collect())) == sorted(map(str, CO.fixture_turns(spark, SF).select(turns.columns).collect()))
    more_scan_tasks(spark)
    assert int(spark.conf.get("spark.sql.files.minPartitionNum")) >= spark.sparkContext.defaultParallelism


def test_report_augments_only_turns_that_may_change(spark, monkeypatch):
    from parlance.operators import disfluency_stats as DS

    seen, augment = [], DS.augment_turns
    monkeypatch.setattr(DS, "augment_turns", lambda turns, *a, **k: seen.append(turns) or augment(turns, *a, **k))
    C.QUERIES["disfluency_report"](spark, SF)
    assert len(seen) == 1 and seen[0].where("turn_idx % 2 = 1 or text = '<SILENCE>'").isEmpty()


def test_counting_job_augments_once(spark, tmp_path):
    from parlance.operators import disfluency_stats as DS

    turns, cfg = corpus(spark), ActionConfig.preset("default")
    calls = spark.sparkContext.accumulator(0)
    aug = AU.augment_turns(turns, cfg, V.SlotVocabulary.build(V.slot_values(turns)))

    def tally(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    counted = DS.write_counted(aug.mapInArrow(tally, aug.schema), cfg, str(tmp_path / "out"))
    assert dict(map(tuple, counted.collect()))["turns_written"] == turns.count() == calls.value


def test_frequent_side_of_the_filter_is_stored(spark):
    out = S.infrequent_turns(corpus(spark))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 0 and "LeftAnti" in plan
