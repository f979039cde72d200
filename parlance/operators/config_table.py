"""Augmentation under many configurations at once (D7, I5): the configuration is data.

`augment_turns` compiles one configuration into literals of its expressions.  Here every configuration is a row
(id, token types, limits, weights by token type, templates as pieces), and one pair of folds reads
limits, weights and templates from the row: the corpus is scanned once and the plan has the same size,
whatever the number of configurations.  Draws are keyed by the configuration's id, so the rows equal
those of `augment_turns` run with each configuration.

A configuration is a few kilobytes of JSON from a file that the user names; the rows of all of them are
one literal array of the plan, and a turn is exploded into (turn, number of the configuration).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import block_digits, block_draw, digits_draw, draw_key, key_digits, pick_index, uniform, uniform_blocks
from ..functions.text import (PREPOSITIONS, _slice0, clean_text, closed_class_pos, in_set, is_silence, let,
                              phrase_bounds, tokenize)
from ..sources.config import TOKEN_TYPES, ActionConfig
from .augment import DRAW_KEY, TYPE_CODE, VALUE_ACTIONS, _insert_correction_turns, firing_digits
from .vocab import SlotVocabulary

#: Kinds of actions by number (an unknown name is -1: nothing happens), and what their templates may hold: first and
#: second placeholder.
KINDS = ["NULL", "hesitate", "selfcheck", "restart", "pp_restart", "correct", "multiturn_correct", "correct_long_distance"]
PLACEHOLDERS = {
    "hesitate": ("$token", None), "selfcheck": ("$token", None), "restart": ("$token", "$utterance_from_beginning"),
    "pp_restart": ("$token", "$pp"), "correct": ("$incorrect_value", "$correct_value"),
    "multiturn_correct": ("$incorrect_value", "$correct_value"), "correct_long_distance": ("$incorrect_phrase", "$correct_phrase"),
}
#: A piece of a template: a word (0), the first (1) or second (2) filling, or a word with placeholders inside (3).
WORD, FIRST, SECOND, MIXED = 0, 1, 2, 3
ROW_TYPE = ("struct<id:string,from:array<string>,three:boolean,glimit:int,null_at:int,acts:array<struct<name:string,kind:int,limit:int,"
            "w:array<double>,first:string,second:string,templates:array<array<struct<k:int,w:string>>>>>>")


def _pieces(action: str, template: str) -> list[dict]:
    first, second = PLACEHOLDERS.get(action, (None, None))
    out = []
    for word in template.split():
        known = [p for p in (first, second) if p]
        k = FIRST if word == first else SECOND if word == second else MIXED if any(p in word for p in known) else WORD
        out.append({"k": k, "w": word})
    return out


def config_row(cfg: ActionConfig) -> dict:
    """A configuration as data.  Actions that can never be drawn are left out; the others keep their order."""
    names = [a for a in cfg.actions if a == "NULL" or cfg.can_fire(a)]
    acts = []
    for a in names:
        first, second = PLACEHOLDERS.get(a, (None, None))
        weights = [cfg.base_weight(t, a) if cfg.limit(a) > 0 else 0.0 for t in TOKEN_TYPES]
        acts.append({"name": a, "kind": KINDS.index(a) if a in KINDS else -1, "limit": min(cfg.limit(a), 1 << 30), "w": weights,
                     "first": first or "", "second": second or "", "templates": [_pieces(a, t) for t in cfg.templates.get(a, [])]})
    fires = [any(x["w"][t] > 0 for x in acts if x["name"] != "NULL") for t in range(len(TOKEN_TYPES))]
    bounds = firing_digits(cfg) or ["" if f else None for f in fires]
    return {"id": cfg.config_id, "from": bounds, "three": cfg.token_types == "three", "glimit": min(cfg.limit("GLOBAL"), 1 << 30),
            "null_at": names.index("NULL") if "NULL" in names else -1, "acts": acts}


def _splice(arr: Column, start: Column, end: Column, ins: Column) -> Column:
    """arr[0:start] ++ ins ++ arr[end:] (0-based, end exclusive)."""
    return F.concat(F.slice(arr, F.lit(1), start), ins, F.slice(arr, end + 1, F.size(arr)))


def config_table(spark: SparkSession, cfgs: Sequence[ActionConfig]) -> DataFrame:
    """The configurations as a table, one row each."""
    rows = F.from_json(F.lit(json.dumps([config_row(c) for c in cfgs])), f"array<{ROW_TYPE}>")
    return spark.range(1).select(F.inline(rows))


def _sample(cfg: Column, tokens: Column, digests: Column) -> Column:
    """F3b with the limits and weights of the row `cfg`; array<struct<i:int,a:int>> of the drawn actions.
    `tokens` are (type, index) of the utterance's tokens, `digests` their draws.

    Tokens that cannot draw an action (`firing_digits`) are not gone through: they draw NULL, which changes
    nothing unless NULL itself may run out (a limit below the number of tokens).
    """
    spare = F.when(cfg["null_at"] >= 0, cfg["acts"][F.greatest(cfg["null_at"], F.lit(0))]["limit"] >= F.size(tokens)).otherwise(F.lit(False))
    elems = F.when(spare, F.filter(tokens, lambda x: block_digits(digests, x["i"]) >= cfg["from"][x["t"]])).otherwise(tokens)
    zero = F.struct(F.transform(cfg["acts"], lambda a: F.lit(0)).alias("c"), F.lit(0).alias("g"),
                    F.array().cast("array<struct<i:int,a:int>>").alias("picks"))

    def weights(st, x):
        return F.transform(cfg["acts"], lambda a, k: F.when(
            (st["c"][k] < a["limit"]) & ((a["kind"] == 0) | (st["g"] < cfg["glimit"])), a["w"][x["t"]]).otherwise(F.lit(0.0)))

    def choose(ws, u):
        total = F.aggregate(ws, F.lit(0.0), lambda s, w: s + w)
        first = let(total * u, lambda limit: F.aggregate(
            ws, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k"), F.lit(-1).alias("at")), lambda s, w: F.struct(
                (s["sum"] + w).alias("sum"), (s["k"] + 1).alias("k"),
                F.when((s["at"] < 0) & (s["sum"] + w > limit), s["k"]).otherwise(s["at"]).alias("at")))["at"])
        return let(first, lambda k: F.when(k < 0, cfg["null_at"]).otherwise(k))

    def drawn(st, a, i):
        fired = (a >= 0) & (a != cfg["null_at"])
        return F.struct(F.transform(st["c"], lambda n, k: n + F.when(k == a, 1).otherwise(0)).alias("c"),
                        (st["g"] + F.when(fired, 1).otherwise(0)).alias("g"),
                        F.when(fired, F.concat(st["picks"], F.array(F.struct(i.alias("i"), a.alias("a"))))).otherwise(st["picks"]).alias("picks"))

    return F.aggregate(elems, zero, lambda st, x: F.when(st["g"] >= cfg["glimit"], st).otherwise(let(weights(st, x), lambda ws: let(
        choose(ws, block_draw(digests, x["i"])), lambda a: drawn(st, a, x["i"])))))["picks"]  # at the limit only NULL is left


def _filled(act: Column, pieces: Column, one: Column, two: Column) -> Column:
    """The tokens of a template whose placeholders are filled with the token arrays `one` and `two`."""
    def mixed(word):
        # the longer placeholder first: it may hold the shorter one
        text = let(F.struct(F.array_join(one, " ").alias("a"), F.array_join(two, " ").alias("b")), lambda f: F.when(
            F.length(act["first"]) >= F.length(act["second"]), _swap(_swap(word, act["first"], f["a"]), act["second"], f["b"])).otherwise(
            _swap(_swap(word, act["second"], f["b"]), act["first"], f["a"])))
        return tokenize(text)

    return F.flatten(F.transform(pieces, lambda p: F.when(p["k"] == WORD, F.array(p["w"])).when(p["k"] == FIRST, one)
                                 .when(p["k"] == SECOND, two).otherwise(mixed(p["w"]))))


def _swap(text: Column, placeholder: Column, by: Column) -> Column:
    return F.when(placeholder == "", text).otherwise(F.replace(text, placeholder, by))


def _rewrite(cfg: Column, vocab: SlotVocabulary, tokens: Column, pos: Column, picks: Column, key: Column) -> Column:
    """F4 with the templates of the row `cfg`; struct(toks, ins)."""
    none = F.array().cast("array<string>")
    zero = F.struct(tokens.alias("toks"), none.alias("ins"))
    kinds = [KINDS.index(a) for a in VALUE_ACTIONS]
    correct, multi, far = kinds[0], KINDS.index("multiturn_correct"), KINDS.index("correct_long_distance")
    restart, pp, check = KINDS.index("restart"), KINDS.index("pp_restart"), KINDS.index("selfcheck")

    def span(toks, i, kind, word, wrong):
        """Where the action writes, [s, e), and its two fillings."""
        one = F.array(word)
        det = F.coalesce(F.try_element_at(pos, i + 2) == F.lit("DT"), F.lit(False)) & (i + 1 < F.size(toks))

        def parts(s, e, a, b):
            return F.struct(s.alias("s"), e.alias("e"), a.alias("a"), b.alias("b"))

        def phrase(b):
            right = _slice0(toks, i + 1, b["end"] - i)
            left = _slice0(toks, b["begin"], i - b["begin"])
            return parts(b["begin"], b["end"] + 1, F.concat(left, F.array(wrong), right), F.concat(left, one, right))

        return (F.when(kind == far, let(phrase_bounds(toks, i), phrase))
                .when(kind == pp, parts(i, i + 1 + F.when(det, 1).otherwise(0), one,
                                        F.when(det, F.array(word, F.try_element_at(toks, i + 2))).otherwise(one)))
                .when(kind == restart, parts(i, i + 1, one, F.slice(toks, 1, i + 1)))
                .when((kind == correct) | (kind == multi), parts(i, i + 1, F.array(wrong), one))
                .otherwise(parts(i, i + 1, one, none)))

    def acted(st, i, act, word, wrong, slot):
        toks, n = st["toks"], F.size(act["templates"])
        template = F.element_at(act["templates"], pick_index(digits_draw(key_digits(key, i, "template")), n) + 1)
        ok = (n > 0) & (act["kind"] > 0) & (~in_set(act["kind"], kinds) | wrong.isNotNull()) & ((act["kind"] != check) | slot)
        done = let(span(toks, i, act["kind"], word, wrong), lambda p: let(_filled(act, template, p["a"], p["b"]), lambda said: F.when(
            act["kind"] == multi, F.struct(_splice(toks, p["s"], p["e"], F.array(wrong)).alias("toks"),
                                           F.concat(st["ins"], F.array(F.array_join(said, " "))).alias("ins"))).otherwise(
            F.struct(_splice(toks, p["s"], p["e"], said).alias("toks"), st["ins"].alias("ins")))))
        return F.when(ok, done).otherwise(st)

    def step(st, p):
        i = p["i"]
        return let(F.element_at(cfg["acts"], p["a"] + 1), lambda act: let(F.element_at(st["toks"], i + 1), lambda word: (
            let(F.when(in_set(act["kind"], kinds), vocab.wrong_value(word, digits_draw(key_digits(key, i, "value")))),
                lambda wrong: acted(st, i, act, word, wrong, vocab.is_slot(word)))
            if vocab.inlined else acted(st, i, act, word, p["wrong"], p["slot"]))))

    return F.aggregate(F.reverse(picks), zero, step)


def augment_by_table(turns: DataFrame, table: DataFrame, vocab: SlotVocabulary, seed: int = 273,
                     select: str = "parity", replacements: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Every turn under every configuration of `table`: `config_id`, the input columns, `copy_no`, `orig_turn_idx`,
    `selected`, `n_tokens`, `actions`, `text`, `inserted`, as `augment_turns` gives them (without tags).

    Repeated turns are augmented each; an empty table of configurations gives no rows.
    """
    rows = [r.asDict(recursive=True) for r in table.collect()]  # a few kilobytes for each configuration
    configs = F.from_json(F.lit(json.dumps(rows)), f"array<{ROW_TYPE}>")
    if "copy_no" not in turns.columns:
        turns = turns.withColumn("copy_no", F.lit(0))
    t = turns.withColumn("_toks", tokenize(clean_text("text", replacements)))
    chosen = (F.col("turn_idx") % 2 == 0) if select == "parity" else F.col("agent") == "user"
    t = t.withColumn("_sel", chosen & ~is_silence("_toks"))
    if not vocab.inlined:
        t = vocab.annotate(t, "_toks")
    t = t.withColumn("_cfg", F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1)) if rows else F.array().cast("array<int>")))
    cfg = F.element_at(configs, F.col("_cfg") + 1)
    t = t.withColumn("config_id", cfg["id"])
    keys = [F.lit(seed), F.col("config_id"), *(F.col(c) for c in DRAW_KEY)]
    t = t.withColumn("_draws", draw_key(*keys))
    key = F.col("_draws")

    def type_of(tok, i, three):
        slot = vocab.is_slot(tok) if vocab.inlined else F.col("_slot")[i]
        return (F.when(slot, F.lit(TYPE_CODE["slot_value"]))
                .when(three & in_set(tok, PREPOSITIONS) & (tok != F.lit("like")), F.lit(TYPE_CODE["pp_start"]))
                .otherwise(F.lit(TYPE_CODE["background_word"])))

    def picked(c):
        types = F.transform("_toks", lambda tok, i: F.struct(type_of(tok, i, c["three"]).alias("t"), i.alias("i")))
        return let(uniform_blocks("_toks", key, purpose="action"), lambda h: _sample(c, types, h))

    drawn = let(cfg, lambda c: F.when(F.col("_sel"), picked(c)).otherwise(F.array().cast("array<struct<i:int,a:int>>")))
    if not vocab.inlined:
        kinds = [KINDS.index(a) for a in VALUE_ACTIONS]
        kind_of = lambda a: F.element_at(cfg["acts"], a + 1)["kind"]
        t = vocab.draw_wrong_values(t.withColumn("_picks", drawn), "_toks", "_picks", [*DRAW_KEY, "config_id", "_cfg"],
                                    lambda i: uniform(*keys, i, "value"), lambda a: in_set(kind_of(a), kinds))
        drawn = F.col("_picks")
    pos = closed_class_pos("_toks")

    def outputs(c, p):
        rewritten = F.when(F.size(p) > 0, _rewrite(c, vocab, F.col("_toks"), pos, p, key))
        return let(rewritten, lambda r: F.struct(
            F.transform(p, lambda x: F.struct(x["i"].alias("i"), F.element_at(c["acts"], x["a"] + 1)["name"].alias("action"))).alias("actions"),
            F.array_join(F.coalesce(r["toks"], F.col("_toks")), " ").alias("text"),
            F.coalesce(r["ins"], F.array().cast("array<string>")).alias("inserted")))

    out = t.select("config_id", *[c for c in turns.columns if c not in ("text", "config_id")], F.col("turn_idx").alias("orig_turn_idx"),
                   F.col("_sel").alias("selected"), F.when(F.col("_sel"), F.size("_toks")).otherwise(F.lit(0)).alias("n_tokens"),
                   F.inline_outer(F.array(let(cfg, lambda c: let(drawn, lambda p: outputs(c, p))))))
    if any(a["name"] == "multiturn_correct" for r in rows for a in r["acts"]):
        out = _insert_correction_turns(out, ["config_id"])
    return out
