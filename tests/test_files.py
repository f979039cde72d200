"""File round trips and the edge cases of the dialogue formats."""

import json

import pytest
from pyspark.sql import functions as F

from parlance.operators.pairs import lineage_join, user_pairs, zip_join
from parlance.sinks import dialogue_text as B
from parlance.sources import dialogue_text as A
from parlance.sources.corpus import SPLIT_ORDER, load_corpus

SF_SMALL = "/root/testdata/sf0.001"


def parsed(spark, tmp_path, lines):
    p = tmp_path / "lines.txt"
    p.write_bytes("\n".join(lines).encode())
    records = A.read_dialogue_records(spark, str(p))
    return sorted((r.dialogue_no, r.turn_idx, r.agent, r.text, r.malformed) for r in A.parse_dialogue_records(records).collect())


def test_corpus_round_trip_through_split_folders(spark, tmp_path):
    turns = load_corpus(spark, SF_SMALL)
    path = str(tmp_path / "corpus")
    B.write_dialogue_text(turns, path)
    back = A.read_split_dialogues(spark, path)
    assert back.select("dialogue_id").distinct().count() == turns.select("dialogue_id").distinct().count() == 1500
    order = turns.select("split", "dialogue_idx").distinct().collect()
    number = {}
    for s in SPLIT_ORDER:
        for n, i in enumerate(sorted(r.dialogue_idx for r in order if r.split == s)):
            number[s, i] = n + 1
    want = sorted((r.split, number[r.split, r.dialogue_idx], r.turn_idx, r.agent, r.text) for r in turns.collect())
    assert sorted((r.split, r.dialogue_no, r.turn_idx, r.agent, r.text) for r in back.collect()) == want
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        A.read_split_dialogues(spark, path, ["trn", "missing"]).count()


def test_line_edge_cases(spark, tmp_path):
    assert parsed(spark, tmp_path, ["1 a\tb\tc\td", "", "", "  ", "2 x\ty"]) == [
        (1, 0, "system", None, True), (2, 0, "user", "x", False), (2, 1, "system", "y", False)]
    p = tmp_path / "dialog-dev.txt"
    p.write_bytes("1 hi\tyo\r\n\r\n2 a b\tapi_callX y\n".encode())
    rows = sorted((r.dialogue_no, r.turn_idx, r.text) for r in A.read_dialogues(spark, str(p)).collect())
    # only \n ends a line: the \r stays, and a line of \r alone does not end a dialogue
    assert rows == [(1, 0, "hi"), (1, 1, "yo\r"), (1, 2, "a b"), (1, 3, "api_callX y")]


def test_long_dialogues_keep_their_lines_in_order(spark, tmp_path):
    turns = spark.range(2 * 24_000).select(
        F.lit("trn").alias("split"), F.floor(F.col("id") / 24_000).alias("dialogue_idx"),
        (F.col("id") % 24_000).cast("int").alias("turn_idx"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("system").alias("agent"), F.col("id").cast("string").alias("text"))
    B.write_dialogue_text(turns, str(tmp_path / "long"))
    back = A.read_dialogues(spark, str(tmp_path / "long" / "split=trn"))
    bad = back.where(F.col("text").cast("long") != (F.col("dialogue_no") - 1) * 24_000 + F.col("turn_idx"))
    assert back.count() == 48_000 and bad.count() == 0


def test_csv_and_pair_files(spark, tmp_path):
    rows = [(i, f'say "{i}"; then, x', f"o{i};") for i in range(50)]
    df = spark.createDataFrame(rows, "n int, augmented string, original string")
    B.write_parallel_csv(df, str(tmp_path / "csv"))
    back = A.read_parallel_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(r[1:] for r in rows)
    pairs = df.select("n", F.col("augmented").alias("encoder"), F.col("original").alias("decoder")).repartition(3)
    B.write_pair_files(pairs, str(tmp_path / "pairs"), ["n"])
    got = A.read_pair_files(spark, str(tmp_path / "pairs")).orderBy("part", "line").collect()
    assert [(r.encoder, r.decoder) for r in got] == [r[1:] for r in rows]


def test_dstc6_json(spark, tmp_path):
    def d(i, n, answer):
        return {"dialogue_idx": i, "utterances": [f"u{k}" for k in range(n)], "answer": {"utterance": answer}}

    p = tmp_path / "d.json"
    p.write_text(json.dumps([d(1, 3, "api_call a"), d(2, 2, "api_call b"), d(3, 1, "no call")]))
    df = A.read_dstc6(spark, str(p), multi_line=True)
    assert [(r.dialogue_idx, r.line) for r in A.dstc6_turns(df).orderBy("line_no").collect()] == [
        (1, "1 u0\tu1"), (1, "2 u2\tapi_call a")]
    assert [tuple(r) for r in A.dstc6_rejects(df).collect()] == [(2, 3)]


def test_positional_pairs_of_unequal_corpora(spark):
    cols = "split string, dialogue_idx long, turn_idx int, agent string, text string"
    a = spark.createDataFrame([("t", 1, 0, "user", "uhm hi"), ("t", 1, 1, "system", "yo"), ("t", 1, 2, "user", "more")], cols)
    b = spark.createDataFrame([("t", 1, 0, "user", "hi"), ("t", 1, 1, "system", "yo"), ("t", 2, 0, "user", "<SILENCE>")], cols)
    z = zip_join(a, b)
    assert z.where("unpaired").count() == 2
    assert [(r.augmented, r.original) for r in user_pairs(z).collect()] == [("uhm hi", "hi")]


def test_ranges_of_a_file_start_at_records(spark, tmp_path):
    """Byte ranges far smaller than the file: dialogues and numbers keep their order, none is cut or read twice."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    dialogues = [[f"{k + 1} user {n} {'é' * (n % 17)}\tsystem {k}" for k in range(1 + n % 4)] for n in range(300)]
    gaps = ["\n\n", "\n\n\n", "\n\n\n\n\n", "\n\n \t\n\n"]
    text = "\n" + "".join("\n".join(d) + gaps[n % 4] for n, d in enumerate(dialogues))
    (tmp_path / "dialog-trn.txt").write_bytes(text.encode())
    numbers = [(i * 7919) % 2003 for i in range(2003)]
    (tmp_path / "line.txt").write_text(";".join(map(str, numbers)) + "\n")
    (tmp_path / "spaces.txt").write_text(" ".join(map(str, numbers)))
    few = [["first"], *dialogues[:12], ["long"] * 60, *dialogues[40:50], ["last"]]
    (tmp_path / "few.txt").write_text("".join("\n".join(d) + gaps[n % 3] for n, d in enumerate(few)))
    (tmp_path / "empty.txt").write_text("\n\n\n")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        records = A.read_dialogue_records(spark, str(tmp_path / "dialog-trn.txt"))
        assert [(r.dialogue_no, r.lines) for r in records.orderBy("dialogue_no").collect()] == [(n + 1, d) for n, d in enumerate(dialogues)]
        for name, sep in (("line.txt", ";"), ("spaces.txt", " ")):
            assert A._range_scan(spark, str(tmp_path / name), sep).rdd.getNumPartitions() > 9
            got = A.read_permutation(spark, str(tmp_path / name), sep).orderBy("rank").collect()
            assert [tuple(r) for r in got] == list(enumerate(numbers))
        assert A.read_dialogues(spark, str(tmp_path / "empty.txt")).collect() == []
        for size in (61, 333):  # dialogues longer than many ranges; ends of all kinds at the ranges' ends
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            got = A.read_dialogue_records(spark, str(tmp_path / "few.txt")).orderBy("dialogue_no").collect()
            assert [(r.dialogue_no, r.lines) for r in got] == [(n + 1, d) for n, d in enumerate(few)]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_permutation_in_parts(spark, tmp_path):
    perm = spark.range(10_000).select(F.col("id").alias("rank"), ((F.col("id") * 7919) % 10_000).alias("dialogue_ord"))
    B.write_permutation(perm, str(tmp_path / "p"))
    back = A.read_permutation(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, perm.collect()))


def test_files_of_one_dialogue(spark, tmp_path):
    root = tmp_path / "babble"
    root.mkdir()
    names = ["dialog-trn.txt.10", "dialog-trn.txt.2", "dialog-tst.txt.1", "dialog-tst-OOV.txt.0", "dialog-dev.txt.7", "notes.txt", "x.trn.txt.last"]
    for n in names:
        (root / n).write_text(f"usr:\t{n}\nsys:\tline\n")
    got = A.read_dialogue_files(spark, str(root)).orderBy("ordinal").collect()
    assert [r.name for r in got] == ["dialog-trn.txt.2", "dialog-trn.txt.10", "dialog-dev.txt.7", "dialog-tst.txt.1", "dialog-tst-OOV.txt.0"]
    assert [r.ordinal for r in got] == list(range(5)) and [r.split for r in got] == ["trn", "trn", "dev", "tst", "tst-OOV"]
    assert all(r.content == f"usr:\t{r.name}\nsys:\tline" for r in got)


def test_csv_with_line_ends(spark, tmp_path):
    rows = [("a\nb;c", 'say "x"'), ("plain", "text")]
    B.write_parallel_csv(spark.createDataFrame(rows, "augmented string, original string"), str(tmp_path / "csv"))
    assert sorted(map(tuple, A.read_parallel_csv(spark, str(tmp_path / "csv"), multi_line=True).collect())) == sorted(rows)


def test_lineage_pairs(spark):
    """H4 inserted four turns: every original turn meets its own rewriting, the others are flagged."""
    key = "split string, dialogue_idx long, "
    aug = spark.createDataFrame(
        [("s", 1, t, o, k, a, x) for t, o, k, a, x in [
            (0, 0, 0, "user", "uhm u1"), (1, 1, 0, "system", "s1"), (2, 1, 1, "usr", "c2"), (3, 1, 2, "system", "s1"), (4, 1, 3, "usr", "c1"),
            (5, 1, 4, "system", "s1"), (6, 2, 0, "user", "u2"), (7, 3, 0, "system", "s2"), (8, 9, 0, "user", "lost")]],
        key + "turn_idx int, orig_turn_idx int, inserted_rank int, agent string, text string")
    orig = spark.createDataFrame([("s", 1, t, "user" if t % 2 == 0 else "system", x) for t, x in enumerate(["u1", "s1", "u2", "s2", "u3"])],
                                 key + "turn_idx int, agent string, text string")
    got = [(r.turn_idx, r.orig_turn_idx, r.agent, r.augmented, r.original, r.inserted, r.unpaired)
           for r in lineage_join(aug, orig).collect()]
    assert sorted((g for g in got if not g[6])) == [
        (0, 0, "user", "uhm u1", "u1", False, False), (1, 1, "system", "s1", "s1", False, False), (2, 1, "usr", "c2", None, True, False),
        (3, 1, "system", "s1", None, True, False), (4, 1, "usr", "c1", None, True, False), (5, 1, "system", "s1", None, True, False),
        (6, 2, "user", "u2", "u2", False, False), (7, 3, "system", "s2", "s2", False, False)]
    assert sorted(str(g) for g in got if g[6]) == ["(8, 9, 'user', 'lost', None, False, True)", "(None, 4, 'user', None, 'u3', False, True)"]


def test_counters_of_the_writing_job(spark, tmp_path):
    from parlance.operators import augment as AU
    from parlance.operators import disfluency_stats as DS
    from parlance.operators.vocab import SlotVocabulary, slot_values
    from parlance.plans import catalog as C

    turns = load_corpus(spark, SF_SMALL)
    turns = turns.where("dialogue_idx < 400")
    for cfg in (C.MULTITURN_CONFIG, C.ActionConfig.preset("ablation_all")):
        aug = AU.augment_turns(turns, cfg, SlotVocabulary.build(slot_values(turns)))
        got = dict(map(tuple, DS.write_counted(aug, cfg, str(tmp_path / cfg.config_id)).collect()))
        own = aug.where("inserted_rank = 0") if "inserted_rank" in aug.columns else aug
        want = dict(map(tuple, DS.augmentation_stats(own, cfg).collect()))
        assert {k: v for k, v in got.items() if k != "turns_written"} == want
        assert got["turns_written"] == aug.count() == A.read_split_dialogues(spark, str(tmp_path / cfg.config_id)).count()
    empty = turns.limit(0)
    aug = AU.augment_turns(empty, cfg, SlotVocabulary.build(slot_values(turns)))
    assert all(r.value == 0 for r in DS.write_counted(aug, cfg, str(tmp_path / "none")).collect())
