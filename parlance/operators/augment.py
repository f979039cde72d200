"""Disfluency augmentation of user turns.

Per utterance, two native folds run inside the JVM (no Python worker, no shuffle):

1. sampling (F3b): a left-to-right `aggregate` over the tokens whose state holds the used
   count of every action and of GLOBAL; each token draws an action from the masked,
   limit-gated weights of its token type (F3a).  Only non-NULL picks are kept, so the state
   stays small (at most GLOBAL entries).
2. rewriting (F4): a right-to-left `aggregate` over the picks whose state is the current
   token array (plus tags and inserted correction turns); every action replaces a span with
   its rendered template, so indices left of the span stay valid.

Draws are counter-based (`functions.rng.uniform`) on (seed, config, split, dialogue, copy,
turn, token, purpose): the result does not depend on partitioning or task retries.
Templates are literals of the configuration and are expanded token by token, which equals
"replace placeholders, then whitespace-split" because tokens never contain whitespace.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.rng import (block_digits, digits_draw, draw_key, key_digits, least_digits, pick_bounds, uniform,
                             uniform_blocks)
from ..functions.text import (DETERMINERS, PHRASE_LEFT_WORDS, PHRASE_RIGHT_WORDS, PREPOSITIONS, SILENCE, clean_text, in_set,
                              is_silence, tokenize)
from ..functions.text import let as _let
from ..sources.config import TOKEN_TYPES, ActionConfig
from .vocab import SlotVocabulary

TYPE_CODE = {t: i for i, t in enumerate(TOKEN_TYPES)}  # background_word 0, slot_value 1, pp_start 2

_EMPTY_STR_ARR = "array<string>"
VALUE_ACTIONS = ("correct", "multiturn_correct", "correct_long_distance")
DRAW_KEY = ["split", "dialogue_idx", "copy_no", "turn_idx"]  # what a draw depends on; no key of the rows


def _upto(text: Column, n: Column) -> Column:
    """The first n tokens of a space-joined text."""
    return F.call_function("substring_index", text, F.lit(" "), n)


def _head(text: Column, n: Column) -> Column:
    """The first n tokens with the space that parts them from the next."""
    return F.when(n > 0, F.concat(_upto(text, n), F.lit(" "))).otherwise(F.lit(""))


def _after(text: Column, upto: Column) -> Column:
    """What follows the leading part `upto` of a text, with the space before it."""
    return F.substr(text, F.length(upto) + 1)


def _n_spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _joined(head: Column, ins: Column | None, rest: Column) -> Column:
    """head, a replacement (None: nothing at all) and what follows it."""
    return F.concat(head, ins, rest) if ins is not None else F.trim(F.concat(head, F.ltrim(rest)))


def _rep(tag: str, n: Column) -> Column:
    """n > 0 equal tags."""
    return F.concat(F.lit(tag), F.repeat(F.lit(" " + tag), (n - 1).cast("int")))


# ---------------------------------------------------------------- F3b sampling

def firing_digits(cfg: ActionConfig) -> list[str | None] | None:
    """By token type, the digits from which on a draw may be anything but NULL, whatever was drawn before (None: from
    none on).  None for a configuration without such a bound.

    NULL comes first, and its weight stays what it is; limits only take weight from the others.  So a draw that
    falls to NULL under the full weights falls to NULL under any.
    """
    live = [a for a in cfg.actions if a == "NULL" or cfg.can_fire(a)]
    full = [[cfg.base_weight(t, a) if cfg.limit(a) > 0 else 0.0 for a in live] for t in TOKEN_TYPES]
    if live[:1] != ["NULL"] or min(map(min, full)) < 0:
        return None
    return [least_digits(lambda u: w[0] <= reduce(lambda x, y: x + y, w) * u) if any(w[1:]) else None for w in full]


def drawn_tokens(cfg: ActionConfig, tokens: Column, digests: Column, type_of) -> Column:
    """array<struct<t:int,d:string,i:int>> of the tokens (types and digits of the draws) that may draw an action.  All of them
    where no bound is known or NULL itself may run out (a limit below the number of tokens)."""
    def drawn(tok, i, t, digits):
        return F.struct(t.alias("t"), digits.alias("d"), i.alias("i"))

    every = F.transform(tokens, lambda tok, i: drawn(tok, i, type_of(tok, i), block_digits(digests, i)))
    bounds = firing_digits(cfg)
    if bounds is None:
        return every
    # the draw alone tells most tokens; the type is asked for the others
    known = [b for b in bounds if b is not None]
    if not known:
        some = F.array().cast("array<struct<t:int,d:string,i:int>>")
    else:
        background, slot, pp = (F.lit(b).cast("string") for b in bounds)

        def fires(i):
            digits, t = block_digits(digests, i), type_of(tokens[i], i)
            bound = background if background_only else F.when(t == 1, slot).when(t == 2, pp).otherwise(background)
            return (digits >= min(known)) & (digits >= bound)

        background_only = len(set(bounds)) == 1
        at = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), fires)
        some = F.when(F.size(tokens) > 0, F.transform(at, lambda i: drawn(tokens[i], i, type_of(tokens[i], i), block_digits(digests, i)))) \
            .otherwise(F.array().cast("array<struct<t:int,d:string,i:int>>"))
    return F.when(F.size(tokens) <= F.lit(cfg.limit("NULL")), some).otherwise(every)


#: Configurations with more states of used counts than this are sampled by counting.
MOST_STATES = 64


def _states(cfg: ActionConfig) -> tuple[list[list[list[str]]], list[list[int]], int] | None:
    """The sampler as a table, while NULL does not run out: by state (the used counts) and token type the draws from which
    on each action but the first is chosen; by state and action the next state; and the number of the states in
    which an action is left.  None for a configuration with too many states."""
    live = [a for a in cfg.actions if a == "NULL" or cfg.can_fire(a)]
    if live[:1] != ["NULL"] or cfg.limit("NULL") <= 0 or any(cfg.base_weight(t, a) < 0 for t in TOKEN_TYPES for a in live):
        return None
    if any(cfg.base_weight(t, "NULL") <= 0 for t in TOKEN_TYPES):
        return None
    start = (0,) * (len(live) - 1)
    numbers, queue, bounds, moves = {start: 0}, [start], [], []
    for used in queue:
        ok = [sum(used) < cfg.limit("GLOBAL") and n < cfg.limit(a) for n, a in zip(used, live[1:])]
        of_type = []
        for t in TOKEN_TYPES:
            cum = list(accumulate([cfg.base_weight(t, "NULL"), *[cfg.base_weight(t, a) if o else 0.0 for o, a in zip(ok, live[1:])]]))
            of_type.append([least_digits(lambda u, c=c: c <= cum[-1] * u) for c in cum[:-1]])
        bounds.append(of_type)
        follow = []
        for k, o in enumerate(ok):
            then = tuple(n + (j == k) for j, n in enumerate(used)) if o else used
            if then not in numbers:
                if len(numbers) == MOST_STATES:
                    return None
                numbers[then] = len(numbers)
                queue.append(then)
            follow.append(numbers[then])
        moves.append([numbers[used], *follow])
    # states without an action left come last
    open_ = [any(b is not None for of_type in bs for b in of_type) for bs in bounds]
    order = sorted(range(len(bounds)), key=lambda k: not open_[k])
    new = {old: k for k, old in enumerate(order)}
    return [bounds[k] for k in order], [[new[m] for m in moves[k]] for k in order], sum(open_)


def sample_picks(cfg: ActionConfig, elems: Column) -> Column:
    """Fold over array<struct<t:int,d:string,i:int>> (`drawn_tokens`); returns array<struct<i:int,a:int>>.

    By the table of states where there is one; by counting where there is none, or where NULL may run out."""
    table = _states(cfg)
    if table is None:
        return _counted_picks(cfg, elems)
    bounds, moves, n_open = table
    acts = [cfg.actions.index(a) for a in cfg.actions if a == "NULL" or cfg.can_fire(a)]
    # states and types with equal bounds are decided alike
    alike: dict[tuple, list[int]] = {}
    for state, of_type in enumerate(bounds[:n_open]):
        alike.setdefault(tuple(map(tuple, of_type)), []).append(state)

    def by_draw(bs: list[str | None], d: Column) -> Column:
        """Place among the live actions: how many bounds the draw has reached."""
        steps = sorted({b for b in bs if b is not None})
        return _below(d, steps, [F.lit(sum(b is not None and b <= x for b in bs)) for x in ["", *steps]]) if steps else F.lit(0)

    def chosen(state: Column, x: Column) -> Column:
        groups = list(alike.items())

        def by_type(of: tuple) -> Column:
            if len(set(of)) == 1:
                return by_draw(list(of[0]), x["d"])
            return F.when(x["t"] == 0, by_draw(list(of[0]), x["d"])).when(x["t"] == 1, by_draw(list(of[1]), x["d"])) \
                .otherwise(by_draw(list(of[2]), x["d"]))

        expr = by_type(groups[-1][0])
        for of, states in groups[:-1][::-1]:
            expr = F.when(reduce(lambda p, q: p | q, [state == k for k in states]), by_type(of)).otherwise(expr)
        return expr

    n = len(moves[0])
    flat = F.lit([m for row in moves for m in row])
    names = F.lit(acts)
    zero = F.struct(F.lit(0).alias("s"), F.array().cast("array<struct<i:int,a:int>>").alias("picks"))

    def step(acc, x):
        return F.when(acc["s"] >= F.lit(n_open), acc).otherwise(_let(chosen(acc["s"], x), lambda k: F.when(k == 0, acc).otherwise(F.struct(
            F.get(flat, acc["s"] * n + k).alias("s"),
            F.concat(acc["picks"], F.array(F.struct(x["i"].alias("i"), F.get(names, k).alias("a")))).alias("picks")))))

    by_state = lambda e: F.aggregate(e, zero, step)["picks"]
    if n_open == 0:
        by_state = lambda e: F.array().cast("array<struct<i:int,a:int>>")
    return _let(elems, lambda e: F.when(F.size(e) <= F.lit(cfg.limit("NULL")), by_state(e)).otherwise(_counted_picks(cfg, e)))


def _counted_picks(cfg: ActionConfig, elems: Column) -> Column:
    acts = cfg.actions
    null_k = acts.index("NULL") if "NULL" in acts else -1
    g_lim = cfg.limit("GLOBAL")
    # actions that cannot fire have weight 0 throughout: only the others are counted and compared
    live = [k for k, a in enumerate(acts) if a == "NULL" or cfg.can_fire(a)]
    zero = F.struct(*[F.lit(0).alias(f"c{k}") for k in live], F.lit(0).alias("g"),
                    F.array().cast("array<struct<i:int,a:int>>").alias("picks"))

    def weight(acc, x, k, a):
        bases = [cfg.base_weight(t, a) for t in TOKEN_TYPES]
        if cfg.limit(a) <= 0 or not any(bases):
            return F.lit(0.0)
        base = (F.when(x["t"] == 1, F.lit(bases[1])).when(x["t"] == 2, F.lit(bases[2]))
                .otherwise(F.lit(bases[0])))
        ok = acc[f"c{k}"] < F.lit(cfg.limit(a))
        if a != "NULL":
            ok = ok & (acc["g"] < F.lit(g_lim))
        return F.when(ok, base).otherwise(F.lit(0.0))

    def choose(ws, u):
        # first action whose cumulative weight exceeds u * total (exact: integral weights);
        # a scalar CASE chain over prefix sums, no per-element allocation
        cum = [ws[0]]
        for k in range(1, len(live)):
            cum.append(cum[-1] + ws[k])
        return _let(cum[-1] * u, lambda thr: _case_first([(c > thr, k) for c, k in zip(cum, live)], F.lit(-1)))

    def new_state(acc, a, i):
        fired = a != F.lit(null_k)
        return F.struct(
            *[(acc[f"c{k}"] + F.when(a == k, 1).otherwise(0)).alias(f"c{k}")
              for k in live],
            (acc["g"] + F.when(fired, 1).otherwise(0)).alias("g"),
            F.when(fired, F.concat(acc["picks"], F.array(F.struct(i.alias("i"), a.alias("a")))))
            .otherwise(acc["picks"]).alias("picks"))

    def step(acc, x):
        ws = F.array(*[weight(acc, x, k, acts[k]) for k in live])
        drawn = _let(ws, lambda w: _let(
            choose(w, digits_draw(x["d"])),
            lambda a0: _let(F.when(a0 < 0, F.lit(null_k)).otherwise(a0),
                            lambda a: new_state(acc, a, x["i"]))))
        return F.when(acc["g"] >= F.lit(g_lim), acc).otherwise(drawn)  # only NULL is left

    return F.aggregate(elems, zero, step)["picks"]


# ---------------------------------------------------------------- F4 rewriting

def _pieces(template: str, fills: dict) -> list[tuple[str, Column, Column]]:
    """Template tokens as (kind, text, number of tokens) pieces: filled placeholders or literal words."""
    out = []
    for tt in template.split():
        if tt in fills:
            out.append(("ph", *fills[tt]))
        else:
            hits = [p for p in fills if p in tt]
            if hits:  # placeholder inside a longer token
                s = F.lit(tt)
                for p in sorted(hits, key=len, reverse=True):
                    s = F.replace(s, F.lit(p), fills[p][0])
                out.append(("lit", s, _n_spaces(s) + 1))
            else:
                out.append(("lit", F.lit(tt), F.lit(1)))
    return out


def _tags_for(pieces, mode: str) -> Column | None:
    parts, cur, first = [], F.lit(0), True
    for kind, _, n in pieces:
        if kind == "lit":
            parts.append(_rep("<e/>", n))
        elif mode == "plain":
            parts.append(_rep("<f/>", n))
        elif first:
            parts.append(F.lit("<f/>") if mode == "restart" else _rep("<f/>", n))
        else:
            rm = (n * 2) if mode == "restart" else cur
            rm_mid = (n + 1) if mode == "restart" else cur
            parts.append(F.when(n == 1, F.format_string("<rm-%d/><rpEndSub/>", rm))
                         .otherwise(F.concat(F.format_string("<rm-%d/><rpMid/>", rm_mid),
                                             F.repeat(F.lit(" <f/>"), (n - 2).cast("int")), F.lit(" <rpEndSub/>"))))
        cur = cur + n
        first = False
    return _spaced(parts)


def _spaced(parts: list[Column]) -> Column | None:
    """The parts with spaces between them; None for no part."""
    return F.concat(*[x for p in parts for x in (F.lit(" "), p)][1:]) if parts else None


def _render(pieces) -> Column | None:
    return _spaced([text for _, text, _ in pieces])


def _run_length(text: Column, words: Sequence[str]) -> Column:
    """The leading run of ` word`s of a text (regular expression without backtracking, linear in the run)."""
    return F.regexp_extract(text, r"\A(?: (?:" + "|".join(map(re.escape, words)) + r")(?= |\z))*+", 0)


def rewrite(cfg: ActionConfig, vocab: SlotVocabulary, tokens: Column, pos: Column | None,
            picks: Column, keys: Sequence[Column], with_tags: bool = True) -> Column:
    """Fold the picks right to left; returns struct(toks, tags, ins) (tags NULL unless asked).

    `keys` are the parts of the row's draws, or its `draw_key` alone.  With a joined vocabulary the picks carry `slot` and `wrong` (see `draw_wrong_values`).
    """
    r = rewrite_text(cfg, vocab, tokens, picks, keys, with_tags)
    return _let(r, lambda x: F.struct(_unjoined(x["text"]).alias("toks"), _unjoined(x["tags"]).alias("tags"), x["ins"].alias("ins")))


def _unjoined(text: Column) -> Column:
    return F.when(text == "", F.array().cast(_EMPTY_STR_ARR)).otherwise(F.split(text, " "))


def rewrite_text(cfg: ActionConfig, vocab: SlotVocabulary, tokens: Column, picks: Column, keys: Sequence[Column],
                 with_tags: bool = True, text: Column | None = None) -> Column:
    """`rewrite` with the tokens and the tags joined by spaces: struct(text, tags, ins).

    Tokens and tags hold no spaces, so that a span is a piece of the text and is replaced without going through the others.
    `text` is what the tokens join to, if it is at hand."""
    acts = cfg.actions
    key = keys[0] if len(keys) == 1 else draw_key(*keys)
    no_tags = F.lit(None).cast("string")
    zero = F.struct((F.array_join(tokens, " ") if text is None else text).alias("text"),
                    (F.when(F.size(tokens) > 0, _rep("<f/>", F.size(tokens))).otherwise("") if with_tags else no_tags).alias("tags"),
                    F.array().cast(_EMPTY_STR_ARR).alias("ins"))
    dets = [w for w in DETERMINERS if w not in PREPOSITIONS]

    def state(st, text=None, tags=None, ins=None):
        if not with_tags:
            tags = no_tags
        return F.struct((text if text is not None else st["text"]).alias("text"),
                        (tags if tags is not None else st["tags"]).alias("tags"),
                        (ins if ins is not None else st["ins"]).alias("ins"))

    def retag(st, start, end, tags):
        return _joined(_head(st["tags"], start), tags, _after(st["tags"], _upto(st["tags"], end)))

    def act_state(st, a, p, i, upto, word):
        templates = cfg.templates.get(a, [])
        if not templates or a == "NULL":
            return st
        uv = digits_draw(key_digits(key, i, "value"))
        slot_ok = vocab.is_slot(word) if vocab.inlined else p["slot"]
        before = F.substr(upto, F.lit(1), F.length(upto) - F.length(word))  # the tokens to the left, and a space
        rest = _after(st["text"], upto)
        one = (word, F.lit(1))

        def put(pieces, mode: str, tail=rest, end=None):
            """The template in place of tokens i to `end`."""
            return state(st, _joined(before, _render(pieces), tail), retag(st, i, i + 1 if end is None else end, _tags_for(pieces, mode)))

        def per_template(tmpl: str, wrong: Column | None, side: Column | None) -> Column:
            if a in ("hesitate", "selfcheck"):
                return put(_pieces(tmpl, {"$token": one}), "plain")
            if a == "restart":
                return put(_pieces(tmpl, {"$token": one, "$utterance_from_beginning": (upto, i + 1)}), "restart")
            if a == "pp_restart":
                det = side["det"] != ""
                pp = (F.concat(word, side["det"]), F.when(det, 2).otherwise(1))
                return put(_pieces(tmpl, {"$token": one, "$pp": pp}), "pp", _after(rest, side["det"]), i + 1 + F.when(det, 1).otherwise(0))
            if a == "correct":
                return put(_pieces(tmpl, {"$incorrect_value": (wrong, F.lit(1)), "$correct_value": one}), "plain")
            if a == "multiturn_correct":
                said = _render(_pieces(tmpl, {"$incorrect_value": (wrong, F.lit(1)), "$correct_value": one}))
                return state(st, F.concat(before, wrong, rest), None, F.concat(st["ins"], F.array(said if said is not None else F.lit(""))))
            if a == "correct_long_distance":
                left = F.substr(before, F.length(before) - F.length(side["left"]) + 1)
                n_left, n_right = _n_spaces(side["left"]), _n_spaces(side["right"])
                n = n_left + 1 + n_right
                pieces = _pieces(tmpl, {"$incorrect_phrase": (F.concat(left, wrong, side["right"]), n),
                                        "$correct_phrase": (F.concat(left, word, side["right"]), n)})
                return state(st, _joined(F.substr(before, F.lit(1), F.length(before) - F.length(side["left"])), _render(pieces),
                                         _after(rest, side["right"])),
                             retag(st, i - n_left, i + 1 + n_right, _tags_for(pieces, "plain")) if with_tags else None)
            return st  # unknown action names are no-ops

        def by_template(wrong: Column | None, side: Column | None = None) -> Column:
            if len(templates) == 1:
                return per_template(templates[0], wrong, side)
            return _let(key_digits(key, i, "template"), lambda d: _below(
                d, pick_bounds(len(templates)), [per_template(t, wrong, side) for t in templates]))

        if a == "correct_long_distance":
            # the phrase around the token; its left part read backwards
            side = F.struct(_run_length(F.reverse(before), [w[::-1] for w in PHRASE_LEFT_WORDS]).alias("left"),
                            _run_length(rest, PHRASE_RIGHT_WORDS).alias("right"))
            run = lambda wv: _let(side, lambda x: by_template(wv, x))
        else:
            run = by_template
        if a in VALUE_ACTIONS:
            wrong = vocab.wrong_value(word, uv) if vocab.inlined else p["wrong"]
            return _let(wrong, lambda wv: F.when(wv.isNotNull(), run(wv)).otherwise(st))
        if a == "pp_restart":
            # the determiner after the token (as the utterance was), as the text has it now, with the space before it
            det = F.coalesce(in_set(F.get(tokens, i + 1), dets), F.lit(False))
            return _let(F.struct(F.when(det & (rest != ""), F.concat(F.lit(" "), _upto(F.substr(rest, F.lit(2)), F.lit(1))))
                                 .otherwise(F.lit("")).alias("det")), lambda x: by_template(None, x))
        if a == "selfcheck":
            return F.when(slot_ok, by_template(None)).otherwise(st)
        return by_template(None)

    def step(st, p):
        i, a = p["i"], p["a"]
        live = [(k, name) for k, name in enumerate(acts) if name != "NULL" and cfg.can_fire(name)]
        return _let(_upto(st["text"], i + 1), lambda upto: _let(F.substring_index(upto, " ", -1), lambda word: _case(
            a, [(k, act_state(st, name, p, i, upto, word)) for k, name in live], st)))

    return F.aggregate(F.reverse(picks), zero, step)


def _below(digits: Column, bounds: list[str], values: list[Column]) -> Column:
    """values[k] where k of the rising bounds are reached."""
    expr = None
    for b, v in zip(bounds, values):
        expr = F.when(digits < b, v) if expr is None else expr.when(digits < b, v)
    return expr.otherwise(values[-1])


def _case_first(conds: list[tuple[Column, int]], default: Column) -> Column:
    """Number of the first true condition (or `default`)."""
    expr = None
    for c, k in conds:
        expr = F.when(c, F.lit(k)) if expr is None else expr.when(c, F.lit(k))
    return expr.otherwise(default) if expr is not None else default


def _case(key: Column, branches: list[tuple[int, Column]], default: Column) -> Column:
    if not branches:
        return default
    expr = None
    for k, val in branches:
        expr = F.when(key == k, val) if expr is None else expr.when(key == k, val)
    return expr.otherwise(default)


# ---------------------------------------------------------------- corpus level

def augment_turns(turns: DataFrame, cfg: ActionConfig, vocab: SlotVocabulary, seed: int = 273,
                  token_types: str = "two", select: str = "parity", with_tags: bool = False,
                  replacements: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Augment every selectable user turn of `turns`; all other turns pass through.

    Output columns: the input columns plus `copy_no` (0 if absent), `orig_turn_idx`,
    `n_tokens`, `actions` (array<struct<i,action>> of the non-NULL draws), `text` rewritten
    (whitespace-normalised for every turn), `tags` (if `with_tags`) and `inserted`
    (correction turns, multi-turn corrections only).
    """
    if "copy_no" not in turns.columns:
        turns = turns.withColumn("copy_no", F.lit(0))
    acts = cfg.actions
    keys = [F.lit(seed), F.lit(cfg.config_id), F.col("split"), F.col("dialogue_idx"),
            F.col("copy_no"), F.col("turn_idx")]
    toks = tokenize(clean_text("text", replacements))
    t = turns.withColumn("_toks", toks).withColumn("_draws", draw_key(*keys)).withColumn("_text", F.array_join("_toks", " "))
    key = F.col("_draws")
    if select == "parity":
        chosen = (F.col("turn_idx") % 2 == 0)
    else:
        chosen = F.col("agent") == "user"
    # only a text that holds the marker may be it; a null text stays null
    silent = is_silence("_toks") if replacements else F.when(F.contains("text", F.lit(SILENCE)), is_silence("_toks")).when(
        F.col("text").isNotNull(), F.lit(False))
    chosen = chosen & ~silent

    if not vocab.inlined:
        t = vocab.annotate(t, "_toks")

    def type_of(tok, i):
        slot = vocab.is_slot(tok) if vocab.inlined else F.col("_slot")[i]
        e = F.when(slot, F.lit(TYPE_CODE["slot_value"]))
        if token_types == "three":
            e = e.when(in_set(tok, PREPOSITIONS) & (tok != F.lit("like")), F.lit(TYPE_CODE["pp_start"]))
        return e.otherwise(F.lit(TYPE_CODE["background_word"]))

    elems = _let(draw_key(*keys), lambda k: _let(uniform_blocks("_toks", k, purpose="action"),
                                                 lambda h: drawn_tokens(cfg, F.col("_toks"), h, type_of)))
    t = t.withColumn("_sel", chosen)
    names = F.array(*[F.lit(a) for a in acts])
    empty_picks = F.array().cast("array<struct<i:int,a:int>>")

    def outputs(p):
        rw = F.when(F.size(p) > 0, rewrite_text(cfg, vocab, F.col("_toks"), p, [key], with_tags, F.col("_text")))
        return _let(rw, lambda r: F.struct(
            F.transform(p, lambda x: F.struct(x["i"].alias("i"),
                                              F.element_at(names, x["a"] + 1).alias("action")))
            .alias("actions"),
            F.coalesce(r["text"], F.col("_text")).alias("text"),
            *([F.coalesce(_unjoined(r["tags"]), F.transform("_toks", lambda x: F.lit("<f/>"))).alias("tags")]
              if with_tags else []),
            F.coalesce(r["ins"], F.array().cast(_EMPTY_STR_ARR)).alias("inserted")))

    # Each sub-result is bound once (`_let`), and the row is emitted through a one-element
    # `inline_outer`: filters on the outputs cannot be pushed below the generator (where they
    # would inline and re-run the folds), and outer generators infer no extra filter.
    drawn = F.when(F.col("_sel"), sample_picks(cfg, elems)).otherwise(empty_picks)
    if not vocab.inlined:
        wants = [k for k, a in enumerate(acts) if a in VALUE_ACTIONS]
        t = vocab.draw_wrong_values(t.withColumn("_picks", drawn), "_toks", "_picks", DRAW_KEY,
                                    lambda i: uniform(*keys, i, "value"), lambda a: in_set(a, wants))
        drawn = F.col("_picks")
    result = _let(drawn, outputs)
    out = t.select(
        *[c for c in turns.columns if c != "text"],
        F.col("turn_idx").alias("orig_turn_idx"),
        F.col("_sel").alias("selected"),
        F.when(F.col("_sel"), F.size("_toks")).otherwise(F.lit(0)).alias("n_tokens"),
        F.inline_outer(F.array(result)),
    )
    if cfg.can_fire("multiturn_correct"):
        out = _insert_correction_turns(out)
    return out


def _insert_correction_turns(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """H4: after a user turn with k correction turns, its next turn becomes
    [S, C_k, S, …, C_1, S]; later turns shift by 2k.  `inserted_rank` is the place in that block: 0 is
    the turn itself, all others are inserted.  Needs the dialogue's turns together
    (a window per dialogue: bounded groups), so it is planned only when H4 can fire."""
    d = Window.partitionBy(*by, "split", "dialogue_idx", "copy_no").orderBy("orig_turn_idx")
    k = F.size("inserted")
    df = (df.withColumn("_prev_ins", F.lag("inserted", 1).over(d))
          .withColumn("_shift", F.coalesce(F.sum(2 * k).over(
              d.rangeBetween(Window.unboundedPreceding, -2)), F.lit(0))))
    prev = F.coalesce("_prev_ins", F.array().cast(_EMPTY_STR_ARR))
    n = F.size(prev)
    # block element m (0..2n): even m -> the turn itself, odd m -> correction C_{n - (m-1)/2}
    block = F.transform(F.sequence(F.lit(0), 2 * n), lambda m: F.struct(
        m.alias("m"),
        F.when(m % 2 == 0, F.col("text")).otherwise(
            F.element_at(prev, (n - (m - 1) / 2).cast("int"))).alias("text"),
        F.when(m % 2 == 0, F.col("agent")).otherwise(F.lit("usr")).alias("agent")))
    cols = [c for c in df.columns if c not in ("text", "agent", "turn_idx", "_prev_ins", "_shift")]
    ex = df.select(*cols, "_shift", F.explode(block).alias("_b"))
    return ex.select(
        *cols,
        (F.col("orig_turn_idx") + F.col("_shift") + F.col("_b.m")).cast("int").alias("turn_idx"),
        F.col("_b.m").cast("int").alias("inserted_rank"),
        F.col("_b.agent").alias("agent"), F.col("_b.text").alias("text"))


def sampled_action_list(aug: DataFrame) -> Column:
    """Per-token action names of an augmented turn ('NULL' where nothing was drawn)."""
    per_token = F.transform(
        F.sequence(F.lit(0), F.col("n_tokens") - 1),
        lambda k: F.coalesce(F.try_element_at(F.filter("actions", lambda p: p["i"] == k), F.lit(1))["action"],
                             F.lit("NULL")))
    return F.when(F.col("n_tokens") > 0, per_token).otherwise(F.array().cast(_EMPTY_STR_ARR))
