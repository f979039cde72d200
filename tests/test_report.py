"""The disfluency report by copy slices: all six sizes against SQL, resuming, slices of any size."""

import duckdb
from pyspark.sql import functions as F

from parlance.operators import disfluency_stats as DS
from parlance.operators.vocab import SlotVocabulary, slot_values
from parlance.plans import catalog as C
from parlance.sources.config import ActionConfig
from parlance.sources.corpus import load_corpus
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def test_six_sizes_match_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = C.QUERIES["disfluency_report_all"](spark, SF)
    res = con.execute(C.report_sql([1, 2, 5, 10]))
    want = rows_of([d[0] for d in res.description], res.fetchall())
    rows = [tuple(r) for r in df.collect()]
    assert [r[0] for r in sorted(rows, key=lambda r: int(r[0][:-1]))] == ["1x", "2x", "5x", "10x", "50x", "100x"]
    assert rows_of(df.columns, [r for r in rows if r[0] not in ("50x", "100x")]) == want
    by = {r[0]: r[1:] for r in rows}
    assert by["100x"][0] == 100 * by["1x"][0] and all(abs(x - 10 * y) < 0.05 * x for x, y in zip(by["100x"], by["10x"]))


def test_slices_and_resuming(spark, tmp_path, monkeypatch):
    turns = load_corpus(spark, SF).where("dialogue_idx < 300")
    turns = turns.unionByName(turns.limit(1).withColumn("text", F.lit(None).cast("string")))
    cfg, vocab = ActionConfig.preset("default"), SlotVocabulary.build(slot_values(turns))
    run = lambda folder, n: sorted(map(str, DS.sliced_report(turns, [1, 3, 7], cfg, vocab, str(folder), slice_copies=n).collect()))
    want = run(tmp_path / "a", 7)
    assert run(tmp_path / "b", 2) == run(tmp_path / "b", 2) == want
    calls = []
    monkeypatch.setattr(DS, "augment_turns", lambda *a, **k: calls.append(1))
    assert run(tmp_path / "b", 2) == want and not calls  # all slices are there


def test_texts_without_triggers_are_not_split(spark):
    """Only texts with the letters of a trigger's first word are split; counts are those of the single kinds."""
    cfg, vocab = ActionConfig.preset("default"), SlotVocabulary({"rome": [0], "paris": [0]})
    texts = ["uhm in rome", "well yes", "paris oh no rome please", "in rome", "uhm yeah sorry", "uhm sorry", "", None, "normal northern oh", "rome  no\u00a0paris now"]
    rows = [(a, x) for x in texts for a in ("user", "system", None)]
    turns = spark.createDataFrame(rows, "agent string, text string")
    report = DS.disfluency_report(turns.withColumn("corpus", F.lit("c")), cfg, vocab)
    row = report.first().asDict()
    assert row["n_turns"] == 30 and row["n_user_turns"] == 10
    for k in DS.KINDS:
        one = DS.count_disfluencies(turns, cfg, vocab, k).first()
        assert (row[f"n_{k}"], row[f"turns_{k}"]) == (one.n_triggers, one.n_turns)
    assert row["n_hesitate"] == 2 and row["n_correct"] == 3
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan.split("Generate")[1].split("\n", 1)[1] and "_told" in plan
