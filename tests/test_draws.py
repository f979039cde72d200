"""Draws and spans of the rewriting folds, beside their plain forms."""

from __future__ import annotations

import inspect

from pyspark.sql import functions as F

from parlance.functions import rng
from parlance.functions.text import phrase_bounds, tokenize
from parlance.operators.vocab import SlotVocabulary
from parlance.operators import augment as AU


def test_digits_of_a_joined_key_are_the_uniform_draw(spark):
    df = spark.createDataFrame([("trn", 1, 0), (None, 2, 3), ("", None, 7)], "s string, d long, i int")
    parts = [F.lit(273), F.col("s"), F.col("d")]
    got = df.withColumn("k", rng.draw_key(*parts)).select(
        rng.uniform(*parts, F.col("i"), "value").alias("u"), rng.digits_draw(rng.key_digits(F.col("k"), F.col("i"), "value")).alias("v"))
    assert all(r.u == r.v for r in got.collect())


def test_template_bounds_pick_as_pick_index(spark):
    for n in (1, 2, 3, 5, 7):
        bounds = rng.pick_bounds(n)
        edges = {0, (1 << 32) - 1} | {int(b, 16) + d for b in bounds for d in (-1, 0)}
        rows = spark.createDataFrame([(f"{x:08x}",) for x in sorted(edges)], "d string")
        got = rows.select(rng.pick_index(rng.digits_draw(F.col("d")), n).alias("a"), AU._below(F.col("d"), bounds, [F.lit(k) for k in range(n)]).alias("b")
                          if n > 1 else F.lit(0).alias("b")).collect()
        assert all(r.a == r.b for r in got)


def test_wrong_values_by_comparison_are_those_by_rank(spark):
    vocab = SlotVocabulary(positions={"a": [0], "é": [0], "z": [0, 1], "b": [1], "lone": [2]},
                           by_pos={0: ["a", "z", "é"], 1: ["b", "z"], 2: ["lone"]})
    of, unions = vocab._signatures()
    us = [0.0, 0.2499, 0.25, 0.34, 0.5, 0.75, 0.9999]
    rows = spark.createDataFrame([(w, u) for w in [*of, "none"] for u in us], "w string, u double")
    got = rows.select("w", "u", vocab.wrong_value(F.col("w"), F.col("u")).alias("x")).collect()
    for r in got:
        number, own = of.get(r.w, (None, None))
        members = unions[number] if number is not None else []
        j = int(r.u * (len(members) - 1)) if len(members) > 1 else 0
        assert r.x == (members[j + (j >= own)] if len(members) > 1 else None)


def test_phrase_bounds_of_short_and_long_runs(spark):
    left, right = ["in", "a", "with", "for", "a"], ["price", "range", "food", "people"]
    for i in range(6):
        for j in range(5):
            toks = ["x"] * (i % 2) + left[:i] + ["v"] + right[:j] + ["y"] * (j % 2)
            at = toks.index("v")
            df = spark.createDataFrame([(" ".join(toks),)], "t string").withColumn("k", tokenize("t"))
            b = df.select(phrase_bounds("k", F.lit(at)).alias("b")).first().b
            assert (b.begin, b.end) == (at - i, at + j)


def test_the_folds_join_no_draw_key():
    """The parts of a draw are joined once a row and not at each pick."""
    assert "uniform(" not in inspect.getsource(AU.rewrite)
