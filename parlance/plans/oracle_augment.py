"""DuckDB oracle for the augmentation: the same draws and semantics written as SQL folds.

`augment_ctes` returns CTEs that turn a turns CTE into augmented rows with DuckDB's
`list_reduce` (sampling left to right, rewriting right to left).  Lists are 1-based here;
token indices in draws are 0-based as in the Spark plan.
"""

from __future__ import annotations

from ..functions.text import DETERMINERS, PHRASE_LEFT_WORDS, PHRASE_RIGHT_WORDS, PREPOSITIONS
from ..sources.config import TOKEN_TYPES, ActionConfig
from .oracle import flag_ctes, sql_str, tok

SA = "VARCHAR[]"


def _in(words) -> str:
    return "(" + ", ".join(sql_str(w) for w in words) + ")"


def _d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def _u(seed: int, cfg_id: str, i: str, purpose: str) -> str:
    parts = [sql_str(str(seed)), sql_str(cfg_id), "split", "CAST(dialogue_idx AS VARCHAR)",
             "CAST(copy_no AS VARCHAR)", "CAST(turn_idx AS VARCHAR)", f"CAST({i} AS VARCHAR)",
             sql_str(purpose)]
    return _digits(parts, "1")


def _u_block(seed: int, cfg_id: str, i: str, purpose: str) -> str:
    """Draw of item i of an array: eight digits of the md5 that four neighbours share."""
    parts = [sql_str(str(seed)), sql_str(cfg_id), "split", "CAST(dialogue_idx AS VARCHAR)",
             "CAST(copy_no AS VARCHAR)", "CAST(turn_idx AS VARCHAR)", f"CAST({i} // 4 AS VARCHAR)", sql_str(purpose)]
    return _digits(parts, f"1 + 8 * ({i} % 4)")


def _digits(parts: list[str], start: str) -> str:
    return (f"(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), {start}, 8))::BIGINT AS DOUBLE)"
            f" / CAST(4294967296 AS DOUBLE))")


def _let(value: str, var: str, body: str) -> str:
    return f"list_transform([{value}], lambda {var}: {body})[1]"


def _rep(tag: str, n: str) -> str:
    return f"list_transform(range(greatest({n}, 0)), lambda _r: {sql_str(tag)})"


def _slice0(arr: str, start0: str, length: str) -> str:
    return f"{arr}[({start0}) + 1:({start0}) + ({length})]"


def _splice(arr: str, s: str, e: str, ins: str) -> str:
    return f"list_concat({arr}[1:{s}], {ins}, {arr}[({e}) + 1:len({arr})])"


def _sample(cfg: ActionConfig, three: bool, seed: int) -> str:
    acts = cfg.actions
    null_k = acts.index("NULL") if "NULL" in acts else -1
    g_lim = cfg.limit("GLOBAL")
    tcode = "CASE WHEN sl[ix + 1] THEN 1 " + (
        f"WHEN x IN {_in(PREPOSITIONS)} AND x <> 'like' THEN 2 " if three else "") + "ELSE 0 END"
    elems = (f"list_transform(range(len(toks)), lambda ix: {_let('toks[ix + 1]', 'x', '{' + "'t': " + tcode + ", "
             + "'u': " + _u_block(seed, cfg.config_id, 'ix', 'action') + ", 'i': CAST(ix AS INTEGER)}")})")
    ws = []
    for k, a in enumerate(acts):
        bases = [cfg.base_weight(t, a) for t in TOKEN_TYPES]
        if cfg.limit(a) <= 0 or not any(bases):
            ws.append(_d(0))
            continue
        base = f"CASE e.t WHEN 1 THEN {_d(bases[1])} WHEN 2 THEN {_d(bases[2])} ELSE {_d(bases[0])} END"
        ok = f"acc.c{k} < {cfg.limit(a)}" + ("" if a == "NULL" else f" AND acc.g < {g_lim}")
        ws.append(f"CASE WHEN {ok} THEN {base} ELSE {_d(0)} END")
    n = len(acts)
    pick = (f"coalesce(list_position(list_transform(range({n}), lambda kk: "
            f"list_sum(w[1:kk + 1]) > list_sum(w) * e.u), true) - 1, {null_k})")
    fields = ", ".join(f"'c{k}': acc.c{k} + CASE WHEN a = {k} THEN 1 ELSE 0 END" for k in range(n))
    new_state = ("{" + fields + f", 'g': acc.g + CASE WHEN a <> {null_k} THEN 1 ELSE 0 END, "
                 f"'picks': CASE WHEN a <> {null_k} THEN list_concat(acc.picks, [{{'i': e.i, 'a': CAST(a AS INTEGER)}}]) "
                 f"ELSE acc.picks END}}")
    step = _let("[" + ", ".join(ws) + "]", "w", _let(pick, "a", new_state))
    zero = "{" + ", ".join(f"'c{k}': 0" for k in range(n)) + ", 'g': 0, 'picks': []::STRUCT(i INTEGER, a INTEGER)[]}"
    return f"list_reduce({elems}, lambda acc, e: {step}, {zero}).picks"


def _pieces(template: str, fills: dict) -> list[tuple[str, str]]:
    out = []
    for tt in template.split():
        if tt in fills:
            out.append(("ph", fills[tt]))
        else:
            hits = [p for p in fills if p in tt]
            if hits:
                s = sql_str(tt)
                for p in sorted(hits, key=len, reverse=True):
                    s = f"replace({s}, {sql_str(p)}, array_to_string({fills[p]}, ' '))"
                out.append(("lit", tok(s)))
            else:
                out.append(("lit", f"[{sql_str(tt)}]"))
    return out


def _render(pieces) -> str:
    return "list_concat(" + ", ".join(a for _, a in pieces) + ")" if len(pieces) > 1 else (
        pieces[0][1] if pieces else f"[]::{SA}")


def _tags(pieces, mode: str) -> str:
    parts, cur = [], "0"
    for idx, (kind, arr) in enumerate(pieces):
        n = f"len({arr})"
        if kind == "lit":
            parts.append(_rep("<e/>", n))
        elif mode == "plain":
            parts.append(_rep("<f/>", n))
        elif idx == 0:
            parts.append("['<f/>']" if mode == "restart" else _rep("<f/>", n))
        else:
            rm = f"({n}) * 2" if mode == "restart" else cur
            rm_mid = f"({n}) + 1" if mode == "restart" else cur
            parts.append(f"CASE WHEN {n} = 1 THEN ['<rm-' || CAST({rm} AS VARCHAR) || '/><rpEndSub/>'] "
                         f"ELSE list_concat(['<rm-' || CAST({rm_mid} AS VARCHAR) || '/><rpMid/>'], "
                         f"{_rep('<f/>', f'{n} - 2')}, ['<rpEndSub/>']) END")
        cur = f"({cur} + {n})"
    return ("list_concat(" + ", ".join(parts) + ")") if len(parts) > 1 else (parts[0] if parts else f"[]::{SA}")


def _rewrite(cfg: ActionConfig, seed: int, with_tags: bool) -> str:
    acts = cfg.actions
    live = [(k, a) for k, a in enumerate(acts) if a != "NULL" and cfg.can_fire(a)]
    T = "st.toks"
    i = "p.i"

    def state(toks=None, tags=None, ins=None):
        tags = ", 'tags': " + (tags or "st.tags") if with_tags else ""
        return "{'toks': " + (toks or T) + tags + ", 'ins': " + (ins or "st.ins") + "}"

    def per_template(a: str, tmpl: str) -> str:
        one = "[word]"
        if a in ("hesitate", "selfcheck"):
            p = _pieces(tmpl, {"$token": one})
            return state(_splice(T, i, f"{i} + 1", _render(p)), _splice("st.tags", i, f"{i} + 1", _tags(p, "plain")))
        if a == "restart":
            p = _pieces(tmpl, {"$token": one, "$utterance_from_beginning": f"{T}[1:{i} + 1]"})
            return state(_splice(T, i, f"{i} + 1", _render(p)), _splice("st.tags", i, f"{i} + 1", _tags(p, "restart")))
        if a == "pp_restart":
            det = f"(coalesce(pos[{i} + 2] = 'DT', false) AND {i} + 1 < len({T}))"
            pp = f"CASE WHEN {det} THEN [word, {T}[{i} + 2]] ELSE [word] END"
            end = f"({i} + 1 + CASE WHEN {det} THEN 1 ELSE 0 END)"
            p = _pieces(tmpl, {"$token": one, "$pp": pp})
            return state(_splice(T, i, end, _render(p)), _splice("st.tags", i, end, _tags(p, "pp")))
        if a == "correct":
            p = _pieces(tmpl, {"$incorrect_value": "[p.w]", "$correct_value": one})
            return state(_splice(T, i, f"{i} + 1", _render(p)), _splice("st.tags", i, f"{i} + 1", _tags(p, "plain")))
        if a == "multiturn_correct":
            p = _pieces(tmpl, {"$incorrect_value": "[p.w]", "$correct_value": one})
            return state(_splice(T, i, f"{i} + 1", "[p.w]"), None,
                         f"list_concat(st.ins, [array_to_string({_render(p)}, ' ')])")
        if a == "correct_long_distance":
            left = (f"coalesce(list_position(list_transform(list_reverse({T}[1:{i}]), "
                    f"lambda x: x IN {_in(PHRASE_LEFT_WORDS)}), false) - 1, {i})")
            right = (f"coalesce(list_position(list_transform({T}[{i} + 2:len({T})], "
                     f"lambda x: x IN {_in(PHRASE_RIGHT_WORDS)}), false) - 1, len({T}) - {i} - 1)")
            correct_ph = f"{T}[bb.b + 1:bb.e + 1]"
            wrong_ph = f"list_concat({T}[bb.b + 1:{i}], [p.w], {T}[{i} + 2:bb.e + 1])"
            p = _pieces(tmpl, {"$incorrect_phrase": wrong_ph, "$correct_phrase": correct_ph})
            body = state(_splice(T, "bb.b", "bb.e + 1", _render(p)),
                         _splice("st.tags", "bb.b", "bb.e + 1", _tags(p, "plain")))
            return _let("{'b': " + f"{i} - {left}" + ", 'e': " + f"{i} + {right}" + "}", "bb", body)
        return "st"

    def by_template(a: str) -> str:
        ts = cfg.templates.get(a, [])
        if len(ts) == 1:
            return per_template(a, ts[0])
        j = f"CAST(floor({_u(seed, cfg.config_id, i, 'template')} * {len(ts)}) AS INTEGER)"
        cases = " ".join(f"WHEN {k} THEN {per_template(a, t)}" for k, t in enumerate(ts))
        return _let(j, "jj", f"CASE jj {cases} ELSE st END")

    def act(a: str) -> str:
        if not cfg.templates.get(a):
            return "st"
        if a in ("correct", "multiturn_correct", "correct_long_distance"):
            return f"CASE WHEN p.w IS NOT NULL THEN {by_template(a)} ELSE st END"
        if a == "selfcheck":
            return f"CASE WHEN p.s THEN {by_template(a)} ELSE st END"
        return by_template(a)

    cases = " ".join(f"WHEN {k} THEN {act(a)}" for k, a in live)
    body = f"CASE p.a {cases} ELSE st END" if live else "st"
    step = _let(f"{T}[{i} + 1]", "word", body)
    first = ", 'tags': list_transform(toks, lambda _x: '<f/>')" if with_tags else ""
    zero = "{'toks': toks" + first + ", 'ins': []::VARCHAR[]}"
    return f"list_reduce(list_reverse(full_picks), lambda st, p: {step}, {zero})"


def augment_ctes(cfg: ActionConfig, turns: str, sv: str, prefix: str, seed: int = 273,
                 three: bool = False, select: str = "parity", with_tags: bool = False) -> list[str]:
    """CTEs `{prefix}_out` with columns of `turns` (text replaced) plus selected, n_tokens,
    picks (list of struct(i, a)), actions, ins and, if asked for, tags.  `turns` needs copy_no."""
    acts = cfg.actions
    sel_expr = ("turn_idx % 2 = 0" if select == "parity" else "agent = 'user'")
    names = "[" + ", ".join(sql_str(a) for a in acts) + "]"
    pos = (f"list_transform(toks, lambda x: CASE WHEN x IN {_in(PREPOSITIONS)} THEN 'IN' "
           f"WHEN x IN {_in(DETERMINERS)} THEN 'DT' ELSE 'X' END)")
    no_picks = "[]::STRUCT(i INTEGER, a INTEGER, s BOOLEAN, w VARCHAR)[]"
    return [
        f"""{prefix}_conf AS MATERIALIZED (
  SELECT a.value, coalesce(list_sort(list_distinct(list(b.value) FILTER (WHERE b.value <> a.value))), []::{SA}) AS conf
  FROM {sv} a JOIN {sv} b ON a.slot_pos = b.slot_pos GROUP BY a.value)""",
        f"""{prefix}_in AS MATERIALIZED (
  SELECT t.*, {tok('t.text')} AS toks, row_number() OVER () AS rid FROM {turns} t)""",
        *flag_ctes(prefix, f"{prefix}_in", "toks", sv),
        f"""{prefix}_s AS (
  SELECT n.*, f.sl, ({sel_expr} AND NOT (n.toks = ['<SILENCE>'])) AS selected
  FROM {prefix}_in n LEFT JOIN {prefix}_fl f ON n.toks = f.toks)""",
        f"""{prefix}_p AS MATERIALIZED (
  SELECT s.*, CASE WHEN selected THEN {_sample(cfg, three, seed)}
                   ELSE []::STRUCT(i INTEGER, a INTEGER)[] END AS picks
  FROM {prefix}_s s)""",
        f"""{prefix}_k AS (
  SELECT rid, list({{'i': i, 'a': a, 's': value IS NOT NULL,
                     'w': conf[CAST(floor({_u(seed, cfg.config_id, 'i', 'value')} * len(conf)) AS INTEGER) + 1]}} ORDER BY i) AS full_picks
  FROM (SELECT *, k.i AS i, k.a AS a FROM (SELECT * EXCLUDE (picks), unnest(picks) AS k FROM {prefix}_p WHERE len(picks) > 0)) x
       LEFT JOIN {prefix}_conf c ON x.toks[x.i + 1] = c.value GROUP BY rid)""",
        f"""{prefix}_r AS (
  SELECT p.*, CASE WHEN len(full_picks) > 0 THEN {_rewrite(cfg, seed, with_tags)} END AS rw
  FROM (SELECT p.*, coalesce(k.full_picks, {no_picks}) AS full_picks, {pos} AS pos
        FROM {prefix}_p p LEFT JOIN {prefix}_k k USING (rid)) p)""",
        f"""{prefix}_out AS (
  SELECT * EXCLUDE (text, toks, sl, rid, rw, pos, full_picks), turn_idx AS orig_turn_idx,
         array_to_string(coalesce(rw.toks, toks), ' ') AS text,
         {"coalesce(rw.tags, list_transform(toks, lambda _x: '<f/>')) AS tags," if with_tags else ""}
         coalesce(rw.ins, []::VARCHAR[]) AS ins,
         CASE WHEN selected THEN len(toks) ELSE 0 END AS n_tokens,
         list_transform(picks, lambda q: {{'i': q.i, 'action': {names}[q.a + 1]}}) AS actions
  FROM {prefix}_r)""",
    ]


def tagger_sql(tokens: str, markers: list[list[str]], phrases: str) -> str:
    """SQL fold of the disfluency tagger over a delexicalised token list.

    `phrases` is an SQL expression of type VARCHAR[][] (delexicalised slot phrases)."""
    M = "[" + ", ".join("[" + ", ".join(sql_str(w) for w in m) + "]::VARCHAR[]" for m in markers) + "]"

    def mtp(buf, lists):
        return (f"(len({buf}) > 0 AND len(list_filter({lists}, lambda m: len(m) >= len({buf}) "
                f"AND m[1:len({buf})] = {buf})) > 0)")

    def pre(buf, target):
        return f"(len({buf}) > 0 AND len({target}) >= len({buf}) AND {target}[1:len({buf})] = {buf})"

    def mk(st, s=None, fl=None, rep=None, itg=None, rpr=None, tags=None):
        return ("{'s': " + (str(s) if s is not None else f"{st}.s") + ", 'fl': " + (fl or f"{st}.fl")
                + ", 'rep': " + (rep or f"{st}.rep") + ", 'itg': " + (itg or f"{st}.itg")
                + ", 'rpr': " + (rpr or f"{st}.rpr") + ", 'tags': " + (tags or f"{st}.tags") + "}")

    def flush(st):
        ni, nr = f"len({st}.itg)", f"len({st}.rpr)"
        return (f"list_concat({st}.tags, {_rep('<f/>', f'{st}.fl')}, "
                f"CASE WHEN {ni} > 0 AND list_contains({M}, {st}.itg) THEN {_rep('<e/>', ni)} ELSE {_rep('<f/>', ni)} END, "
                f"CASE WHEN {nr} = 1 THEN ['<rm-' || CAST({ni} + 1 AS VARCHAR) || '/><rpEndSub/>'] "
                f"WHEN {nr} > 1 THEN list_concat(['<rm-' || CAST({ni} + 1 AS VARCHAR) || '/><rpMid/>'], "
                f"{_rep('<f/>', f'{nr} - 2')}, ['<rpEnd/>']) ELSE []::VARCHAR[] END)")

    st, E = "st", "[]::VARCHAR[]"
    one, itg_t, rep_t, rpr_t = "[t]", "list_concat(st.itg, [t])", "list_concat(st.rep, [t])", "list_concat(st.rpr, [t])"
    fl1 = "st.fl + 1"
    reset = dict(fl="1", rep=E, itg=E, rpr=E)
    fluent = (f"CASE WHEN {mtp(one, M)} THEN {mk(st, s=1, itg=itg_t)} "
              f"WHEN {mtp(rep_t, phrases)} THEN {mk(st, s=2, fl=fl1, rep=rep_t)} ELSE {mk(st, fl=fl1)} END")
    interregnum = (f"CASE WHEN {mtp(itg_t, M)} THEN {mk(st, itg=itg_t)} "
                   f"WHEN {pre(rpr_t, 'st.rep')} THEN {mk(st, s=3, rpr=rpr_t)} "
                   f"WHEN t = '<value>' THEN {mk(st, rpr=one)} "
                   f"ELSE {mk(st, s=0, tags=flush(st), **reset)} END")
    reparandum = (f"CASE WHEN {mtp(rep_t, phrases)} THEN {mk(st, rep=rep_t, fl=fl1)} "
                  f"WHEN {mtp(itg_t, M)} THEN {mk(st, s=1, itg=itg_t)} "
                  f"WHEN {mtp(one, phrases)} THEN {mk(st, s=2, tags=flush(st), fl='1', rep=one, itg=E, rpr=E)} "
                  f"ELSE {mk(st, s=0, tags=flush(st), **reset)} END")
    repair = (f"CASE WHEN {pre(rpr_t, 'st.rep')} THEN {mk(st, rpr=rpr_t)} "
              f"WHEN {mtp(one, M)} THEN {mk(st, s=1, tags=flush(st), fl='0', rep=E, itg=one, rpr=E)} "
              f"WHEN {mtp(one, phrases)} THEN {mk(st, s=2, tags=flush(st), fl='1', rep=one, itg=E, rpr=E)} "
              f"ELSE {mk(st, s=0, tags=flush(st), **reset)} END")
    step = f"CASE st.s WHEN 0 THEN {fluent} WHEN 1 THEN {interregnum} WHEN 2 THEN {reparandum} ELSE {repair} END"
    zero = "{'s': 0, 'fl': 0, 'rep': []::VARCHAR[], 'itg': []::VARCHAR[], 'rpr': []::VARCHAR[], 'tags': []::VARCHAR[]}"
    return _let(f"list_reduce({tokens}, lambda st, t: {step}, {zero})", "fin", flush("fin"))
