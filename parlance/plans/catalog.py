"""Registered queries: one Spark plan per operator of the survey, each with its oracle SQL.

Every query takes (spark, sf_dir), reads the given tables (or the turns corpus Spark derives
from them) in full, and returns a lazy DataFrame whose columns are aliased identically in the
Spark plan and in the DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import stats as S
from ..operators import vocab as V
from ..session import scratch_path
from ..sources.corpus import SPLIT_ORDER, conversations, load_corpus
from . import oracle as O

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def fx(spark: SparkSession, sf: str) -> DataFrame:
    return load_corpus(spark, sf)


# ---------------------------------------------------------------- vocabulary

@query("slot_values", O.fx_vocab_with() + "SELECT slot_pos, value FROM slot_values")
def q_slot_values(spark, sf):
    return V.slot_values(fx(spark, sf))


@query("slot_vocabulary", O.fx_vocab_with() + "SELECT value FROM vocab")
def q_slot_vocabulary(spark, sf):
    return V.slot_vocabulary(fx(spark, sf))


@query("slot_value_tokens", O.fx_vocab_with() + f"""
SELECT split, dialogue_idx, turn_idx, CAST(i - 1 AS INTEGER) AS token_idx, tokens[i] AS token
FROM (SELECT split, dialogue_idx, turn_idx, {O.tok('text')} AS tokens FROM fx) t,
     generate_series(1, len(tokens)) AS g(i)
WHERE tokens[i] IN (SELECT value FROM vocab)""")
def q_slot_value_tokens(spark, sf):
    t = fx(spark, sf)
    return V.slot_value_tokens(t, V.slot_vocabulary(t)).select(
        "split", "dialogue_idx", "turn_idx", F.col("token_idx").cast("int"), "token")


@query("confusable_values", O.fx_vocab_with("""sig AS (
  SELECT value, string_agg(CAST(slot_pos AS VARCHAR), ',' ORDER BY slot_pos) AS positions FROM slot_values GROUP BY value)""",
    "sizes AS (SELECT positions, count(*) AS n_values FROM sig GROUP BY positions)") + """
SELECT DISTINCT positions, b.value AS confusable, n_values
FROM sig JOIN slot_values a ON sig.value = a.value JOIN slot_values b ON a.slot_pos = b.slot_pos JOIN sizes USING (positions)""")
def q_confusable_values(spark, sf):
    return V.confusable_values(V.slot_values(fx(spark, sf)))


# ---------------------------------------------------------------- filters

@query("api_calls", O.fx_with() + """
SELECT split, dialogue_idx, turn_idx, agent, text FROM fx WHERE starts_with(text, 'api_call')""")
def q_api_calls(spark, sf):
    return fx(spark, sf).where(T.is_api_call("text")).select(
        "split", "dialogue_idx", "turn_idx", "agent", "text")


@query("turns_by_agent", O.with_ctes(O.CONV_CTE) + """
SELECT dialogue_idx AS conv_id, turn_idx AS turn, text FROM conv WHERE agent = 'user'""")
def q_turns_by_agent(spark, sf):
    return conversations(spark, sf).where(F.col("agent") == "user").select(
        F.col("dialogue_idx").alias("conv_id"), F.col("turn_idx").alias("turn"), "text")


# ---------------------------------------------------------------- tokens

@query("tokenize", O.with_ctes(O.CONV_CTE) + f"""
SELECT dialogue_idx AS conv_id, turn_idx AS turn, CAST(len({O.tok('text')}) AS BIGINT) AS n_tokens,
       array_to_string({O.tok('text')}, ' ') AS tokens
FROM conv""")
def q_tokenize(spark, sf):
    toks = T.tokenize("text")
    return conversations(spark, sf).select(
        F.col("dialogue_idx").alias("conv_id"), F.col("turn_idx").alias("turn"),
        F.size(toks).cast("bigint").alias("n_tokens"), F.array_join(toks, " ").alias("tokens"))


# ---------------------------------------------------------------- statistics

@query("corpus_stats", O.fx_with() + f"""
SELECT split, count(DISTINCT dialogue_idx) AS n_dialogues,
       CAST(count(*) AS DOUBLE) / count(DISTINCT dialogue_idx) AS mean_turns,
       CAST(sum(CASE WHEN agent = 'system' THEN len({O.tok('text')}) END) AS DOUBLE)
         / count(CASE WHEN agent = 'system' THEN 1 END) AS mean_system_words,
       CAST(sum(CASE WHEN agent = 'user' THEN len({O.tok('text')}) END) AS DOUBLE)
         / count(CASE WHEN agent = 'user' THEN 1 END) AS mean_user_words
FROM fx GROUP BY split""")
def q_corpus_stats(spark, sf):
    return S.corpus_stats(fx(spark, sf))


@query("answer_stats", O.fx_with() + """
SELECT split,
       count(DISTINCT CASE WHEN NOT starts_with(text, 'api_call') THEN text END) AS n_interlocutory,
       count(DISTINCT CASE WHEN starts_with(text, 'api_call') THEN text END) AS n_api_calls
FROM fx WHERE agent = 'system' GROUP BY split
UNION ALL
SELECT 'all',
       count(DISTINCT CASE WHEN NOT starts_with(text, 'api_call') THEN text END),
       count(DISTINCT CASE WHEN starts_with(text, 'api_call') THEN text END)
FROM fx WHERE agent = 'system'""")
def q_answer_stats(spark, sf):
    return S.answer_stats(fx(spark, sf))


_FREQ_SQL = "freq AS (SELECT split, text, count(*) AS freq FROM fx WHERE agent = 'user' GROUP BY split, text)"
_THR_SQL = "thr AS (SELECT split, quantile_cont(freq, 0.95) AS threshold FROM freq GROUP BY split)"


@query("turn_frequency", O.fx_with(_FREQ_SQL) + "SELECT split, text, freq FROM freq")
def q_turn_frequency(spark, sf):
    return S.text_frequency(fx(spark, sf))


@query("frequency_threshold", O.fx_with(_FREQ_SQL, _THR_SQL) +
       "SELECT split, round(threshold, 6) AS threshold FROM thr")
def q_frequency_threshold(spark, sf):
    thr = S.frequency_percentile(S.text_frequency(fx(spark, sf)))
    return thr.select("split", F.round("threshold", 6).alias("threshold"))


@query("frequent_turn_filter", O.fx_with(_FREQ_SQL, _THR_SQL) + """
SELECT t.split, t.dialogue_idx, t.turn_idx, t.text
FROM fx t JOIN freq f ON t.split = f.split AND t.text = f.text JOIN thr h ON t.split = h.split
WHERE t.agent = 'user' AND f.freq < h.threshold""")
def q_frequent_turn_filter(spark, sf):
    return S.infrequent_turns(fx(spark, sf)).select("split", "dialogue_idx", "turn_idx", "text")


@query("unseen_api_calls", O.fx_with() + """
SELECT DISTINCT text FROM fx WHERE agent = 'system' AND starts_with(text, 'api_call') AND split = 'tst'
EXCEPT
SELECT text FROM fx WHERE agent = 'system' AND starts_with(text, 'api_call') AND split = 'trn'""")
def q_unseen_api_calls(spark, sf):
    return S.unseen_api_calls(fx(spark, sf))


# ---------------------------------------------------------------- shared SQL pieces

_SPLIT_RANK_SQL = ("CASE split WHEN 'trn' THEN 0 WHEN 'dev' THEN 1 WHEN 'tst' THEN 2 "
                   "WHEN 'tst-OOV' THEN 3 ELSE 4 END")
_L_WORDS = "('with', 'for', 'in', 'a')"
_R_WORDS = "('cuisine', 'food', 'people', 'price', 'range')"
_VL = "vl AS (SELECT list(value) AS vl FROM vocab)"


def _sql_in(words) -> str:
    return "(" + ", ".join(O.sql_str(w) for w in words) + ")"


def _sql_phrase(toks: str, i: str) -> str:
    """SQL for the enclosing phrase (joined) of 1-based token `i`."""
    left = (f"coalesce(list_position(list_transform(list_reverse({toks}[1:{i} - 1]), "
            f"lambda x: x IN {_L_WORDS}), false) - 1, {i} - 1)")
    right = (f"coalesce(list_position(list_transform({toks}[{i} + 1:len({toks})], "
             f"lambda x: x IN {_R_WORDS}), false) - 1, len({toks}) - {i})")
    return f"array_to_string({toks}[{i} - {left}:{i} + {right}], ' ')"


def _user_turns(spark, sf):
    return fx(spark, sf).where(F.col("agent") == "user")


def _vocab(spark, sf) -> V.SlotVocabulary:
    return V.SlotVocabulary.build(V.slot_values(fx(spark, sf)))


# ---------------------------------------------------------------- sources (A1-A4) and sinks (B1, B2)

from ..operators import ordinals as G  # noqa: E402
from ..sinks import dialogue_text as B  # noqa: E402
from ..sources import dialogue_text as A  # noqa: E402


@query("parse_dialogues", O.fx_with() + """
SELECT split, dialogue_no, turn_idx, agent, text
FROM (SELECT split, dialogue_idx, row_number() OVER (PARTITION BY split ORDER BY dialogue_idx) AS dialogue_no
      FROM (SELECT DISTINCT split, dialogue_idx FROM fx)) d JOIN fx USING (split, dialogue_idx)""")
def q_parse_dialogues(spark, sf):
    """Round trip: the corpus written as dialogue files (B1), one folder per split, and read back (A1, A2)."""
    turns = A.read_split_dialogues(spark, _written_corpus(spark, sf))
    return turns.select("split", "dialogue_no", "turn_idx", "agent", "text")


def _written_corpus(spark, sf) -> str:
    path = scratch_path(spark, "dialogue-files")
    B.write_dialogue_text(fx(spark, sf), path)
    return path


@query("dialogue_records", O.fx_with() + """
SELECT split, dialogue_no, turn_idx // 2 AS line_no,
       printf('%d %s', turn_idx // 2 + 1, max(CASE WHEN turn_idx % 2 = 0 THEN text END)) || chr(9)
         || max(CASE WHEN turn_idx % 2 = 1 THEN text END) AS line
FROM (SELECT split, dialogue_idx, row_number() OVER (PARTITION BY split ORDER BY dialogue_idx) AS dialogue_no
      FROM (SELECT DISTINCT split, dialogue_idx FROM fx)) d JOIN fx USING (split, dialogue_idx)
GROUP BY split, dialogue_no, turn_idx // 2""")
def q_dialogue_records(spark, sf):
    """A10: the raw lines of each dialogue of the written files."""
    records = A.read_dialogue_records(spark, [f"{_written_corpus(spark, sf)}/split={s}" for s in SPLIT_ORDER])
    return records.select(F.regexp_extract("file", r"/split=([^/]+)$", 1).alias("split"), "dialogue_no",
                          F.posexplode("lines").alias("line_no", "line"))


@query("corpus_by_split", O.fx_with() + f"""
SELECT split, {_SPLIT_RANK_SQL} AS split_rank, count(DISTINCT dialogue_idx) AS n_dialogues,
       count(*) AS n_turns
FROM fx GROUP BY split""")
def q_corpus_by_split(spark, sf):
    from ..sources.corpus import split_rank
    return fx(spark, sf).groupBy("split").agg(
        F.countDistinct("dialogue_idx").alias("n_dialogues"), F.count(F.lit(1)).alias("n_turns")
    ).select("split", split_rank(F.col("split")).alias("split_rank"), "n_dialogues", "n_turns")


@query("dialogue_ordinals", O.fx_with() + f"""
SELECT split, dialogue_idx, row_number() OVER (ORDER BY {_SPLIT_RANK_SQL}, dialogue_idx) - 1 AS ordinal
FROM (SELECT DISTINCT split, dialogue_idx FROM fx)""")
def q_dialogue_ordinals(spark, sf):
    return G.dialogue_ordinals(fx(spark, sf))


@query("dstc6_to_turns", O.fx_with() + """
SELECT dialogue_idx, turn_idx // 2 + 1 AS line_no,
       max(CASE WHEN turn_idx % 2 = 0 THEN text END) AS "user",
       max(CASE WHEN turn_idx % 2 = 1 THEN text END) AS system,
       printf('%d %s', turn_idx // 2 + 1, max(CASE WHEN turn_idx % 2 = 0 THEN text END)) || chr(9)
         || max(CASE WHEN turn_idx % 2 = 1 THEN text END) AS line
FROM fx GROUP BY dialogue_idx, turn_idx // 2""")
def q_dstc6_to_turns(spark, sf):
    """DSTC6-shaped dialogues built from the corpus (utterances + final answer), converted back."""
    g = fx(spark, sf).groupBy("dialogue_idx").agg(
        F.array_sort(F.collect_list(F.struct("turn_idx", "text"))).alias("t"))
    texts = F.transform("t", lambda x: x["text"])
    d = g.select("dialogue_idx", F.slice(texts, 1, F.size(texts) - 1).alias("utterances"),
                 F.struct(F.element_at(texts, -1).alias("utterance")).alias("answer"))
    path = scratch_path(spark, "dstc6")
    d.write.json(path)
    return A.dstc6_turns(A.read_dstc6(spark, path))


@query("render_dialogues", O.fx_with() + """
SELECT split, dialogue_idx, string_agg(line, chr(10) ORDER BY k) AS text FROM (
  SELECT split, dialogue_idx, turn_idx // 2 AS k,
         printf('%d %s', turn_idx // 2 + 1, max(CASE WHEN turn_idx % 2 = 0 THEN text END)) || chr(9)
           || max(CASE WHEN turn_idx % 2 = 1 THEN text END) AS line
  FROM fx GROUP BY split, dialogue_idx, turn_idx // 2)
GROUP BY split, dialogue_idx""")
def q_render_dialogues(spark, sf):
    return B.render_dialogues(fx(spark, sf)).select("split", "dialogue_idx", "text")


@query("render_babble", O.fx_with() + """
SELECT split, dialogue_idx, string_agg(agent || ':' || chr(9) || text, chr(10) ORDER BY turn_idx) AS text
FROM fx GROUP BY split, dialogue_idx""")
def q_render_babble(spark, sf):
    return B.render_babble(fx(spark, sf))


# ---------------------------------------------------------------- projections

@query("non_silent_user_turns", O.fx_with() + """
SELECT split, dialogue_idx, turn_idx, text FROM fx WHERE agent = 'user' AND lower(text) <> '<silence>'""")
def q_non_silent_user_turns(spark, sf):
    return _user_turns(spark, sf).where(F.lower("text") != "<silence>").select(
        "split", "dialogue_idx", "turn_idx", "text")


_CLEAN = [("are looking", "are you looking")]


@query("clean_text", O.fx_with() + """
SELECT split, dialogue_idx, turn_idx, replace(text, 'are looking', 'are you looking') AS text FROM fx""")
def q_clean_text(spark, sf):
    return fx(spark, sf).select("split", "dialogue_idx", "turn_idx",
                                T.clean_text("text", _CLEAN).alias("text"))


@query("closed_class_pos", O.fx_with() + f"""
SELECT split, dialogue_idx, turn_idx,
       array_to_string(list_transform({O.tok('text')}, lambda x: CASE WHEN x IN {_sql_in(T.PREPOSITIONS)} THEN 'IN'
         WHEN x IN {_sql_in(T.DETERMINERS)} THEN 'DT' ELSE 'X' END), ' ') AS pos
FROM fx WHERE agent = 'user'""")
def q_closed_class_pos(spark, sf):
    return _user_turns(spark, sf).select(
        "split", "dialogue_idx", "turn_idx",
        F.array_join(T.closed_class_pos(T.tokenize("text")), " ").alias("pos"))


_SIL = f"({O.tok('text')} = ['<SILENCE>'])"


@query("augmentable_turns", O.with_ctes(O.CONV_CTE) + f"""
SELECT dialogue_idx AS conv_id, turn_idx AS turn,
       (turn_idx % 2 = 0 AND NOT {_SIL}) AS by_parity, (agent = 'user' AND NOT {_SIL}) AS by_agent
FROM conv""")
def q_augmentable_turns(spark, sf):
    sil = T.is_silence(T.tokenize("text"))
    return conversations(spark, sf).select(
        F.col("dialogue_idx").alias("conv_id"), F.col("turn_idx").alias("turn"),
        ((F.col("turn_idx") % 2 == 0) & ~sil).alias("by_parity"),
        ((F.col("agent") == "user") & ~sil).alias("by_agent"))


@query("explode_tokens", O.with_ctes(O.CONV_CTE) + f"""
SELECT dialogue_idx AS conv_id, turn_idx AS turn, CAST(i - 1 AS INTEGER) AS token_idx, toks[i] AS token
FROM (SELECT dialogue_idx, turn_idx, {O.tok('text')} AS toks FROM conv), generate_series(1, len(toks)) AS g(i)""")
def q_explode_tokens(spark, sf):
    return conversations(spark, sf).select(
        F.col("dialogue_idx").alias("conv_id"), F.col("turn_idx").alias("turn"),
        F.posexplode(T.tokenize("text")).alias("token_idx", "token"))


_USER_FL = O.flag_ctes("ut", "(SELECT text FROM fx WHERE agent = 'user')", O.tok("text"))
_ALL_FL = O.flag_ctes("al", "fx", O.tok("text"))
_USER_TOKS = (f"(SELECT split, dialogue_idx, turn_idx, {O.tok('text')} AS toks FROM fx WHERE agent = 'user') t "
              "LEFT JOIN ut_fl USING (toks)")


def _annotated_user_turns(spark, sf):
    t = _user_turns(spark, sf).select("split", "dialogue_idx", "turn_idx", T.tokenize("text").alias("toks"))
    return _vocab(spark, sf).annotate(t, "toks")


@query("token_types", O.fx_vocab_with(*_USER_FL) + f"""
SELECT split, dialogue_idx, turn_idx,
       array_to_string(list_transform(toks, lambda x, ix: CASE WHEN sl[ix] THEN 'slot_value'
         WHEN x IN {_sql_in(T.PREPOSITIONS)} AND x <> 'like' THEN 'pp_start' ELSE 'background_word' END), ' ') AS types
FROM {_USER_TOKS}""")
def q_token_types(spark, sf):
    types = F.zip_with("toks", "_slot", lambda x, s: F.when(s, "slot_value")
                       .when(T.in_set(x, T.PREPOSITIONS) & (x != "like"), "pp_start")
                       .otherwise("background_word"))
    return _annotated_user_turns(spark, sf).select("split", "dialogue_idx", "turn_idx",
                                                   F.array_join(types, " ").alias("types"))


@query("enclosing_phrases", O.fx_vocab_with(*_USER_FL) + f"""
SELECT split, dialogue_idx, turn_idx, CAST(i - 1 AS INTEGER) AS token_idx, {_sql_phrase('toks', 'i')} AS phrase
FROM (SELECT * FROM {_USER_TOKS}) t, generate_series(1, len(toks)) AS g(i)
WHERE sl[i]""")
def q_enclosing_phrases(spark, sf):
    ex = _annotated_user_turns(spark, sf).select(
        "*", F.posexplode("_slot").alias("token_idx", "hit")).where("hit")
    return ex.select("split", "dialogue_idx", "turn_idx", "token_idx", F.array_join(
        T.enclosing_phrase("toks", F.col("token_idx")), " ").alias("phrase"))


@query("delexicalize", O.fx_vocab_with(*_USER_FL) + f"""
SELECT split, dialogue_idx, turn_idx, array_to_string({O.delex()}, ' ') AS text FROM {_USER_TOKS}""")
def q_delexicalize(spark, sf):
    return _annotated_user_turns(spark, sf).select(
        "split", "dialogue_idx", "turn_idx", F.array_join(V.delexicalized("toks"), " ").alias("text"))


@query("slot_phrases", O.fx_vocab_with(*_ALL_FL) + f"""
SELECT DISTINCT {_sql_phrase('toks', 'i')} AS phrase FROM al_fl, generate_series(1, len(toks)) AS g(i) WHERE sl[i]""")
def q_slot_phrases(spark, sf):
    return V.slot_phrases(fx(spark, sf), _vocab(spark, sf))


# ---------------------------------------------------------------- windows (F1, F2)

CONTEXT_SIZE = 4


def _windows_sql(source: str) -> str:
    return f"""
SELECT split, dialogue_idx, turn_idx, encoder, decoder FROM (
  SELECT split, dialogue_idx, turn_idx, agent,
         string_agg(text, ' ') OVER (PARTITION BY split, dialogue_idx ORDER BY turn_idx
                                     ROWS BETWEEN {CONTEXT_SIZE - 1} PRECEDING AND CURRENT ROW) AS encoder,
         first_value(CASE WHEN agent <> 'user' THEN text END IGNORE NULLS) OVER (
           PARTITION BY split, dialogue_idx ORDER BY turn_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS decoder
  FROM {source}) WHERE agent = 'user' AND decoder IS NOT NULL"""


def _windows(turns: DataFrame) -> DataFrame:
    from ..operators.windows import context_windows
    return context_windows(turns, CONTEXT_SIZE).select("split", "dialogue_idx", "turn_idx", "encoder", "decoder")


@query("context_windows", O.with_ctes(O.CONV_CTE) + _windows_sql("conv"))
def q_context_windows(spark, sf):
    return _windows(conversations(spark, sf))


@query("corpus_context_windows", O.fx_with() + _windows_sql("fx"))
def q_corpus_context_windows(spark, sf):
    """F1/I8 over the whole corpus."""
    return _windows(fx(spark, sf))


@query("token_bigrams", O.fx_with() + f"""
SELECT toks[i] AS w1, toks[i + 1] AS w2, count(*) AS n
FROM (SELECT {O.tok('text')} AS toks FROM fx WHERE agent = 'user'), generate_series(1, len(toks) - 1) AS g(i)
GROUP BY 1, 2""")
def q_token_bigrams(spark, sf):
    g = _user_turns(spark, sf).select(F.explode(T.ngrams(T.tokenize("text"), 2)).alias("g"))
    return g.groupBy(F.col("g")[0].alias("w1"), F.col("g")[1].alias("w2")).agg(
        F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- ranks, samples, splits

_ORD_SQL = (f"ords AS (SELECT split, dialogue_idx, row_number() OVER (ORDER BY {_SPLIT_RANK_SQL}, dialogue_idx) - 1 "
            "AS ordinal FROM (SELECT DISTINCT split, dialogue_idx FROM fx))")


def _perm_sql() -> str:
    """The keyed permutation as SQL: the same network and walk on a x b."""
    def digits(j, half):
        return f"('0x' || substr(md5(concat_ws('|', '273', '{j}', CAST({half} AS VARCHAR))), 1, 8))::BIGINT"

    expr = "r6 * a + l6"
    for j in range(5, -1, -1):
        old, new = (f"l{j}", f"r{j}"), (f"l{j + 1}", f"r{j + 1}")
        value = f"({old[0]} + {digits(j, old[1])}) % a" if j % 2 == 0 else f"({old[1]} + {digits(j, old[0])}) % b"
        changed, kept = (new[0], new[1]) if j % 2 == 0 else (new[1], new[0])
        same = old[1] if j % 2 == 0 else old[0]
        expr = f"list_transform([{value}], lambda {changed}: list_transform([{same}], lambda {kept}: {expr})[1])[1]"
    net = f"list_transform([x % a], lambda l0: list_transform([x // a], lambda r0: {expr})[1])[1]"
    return f"""dom AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (
  SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM (SELECT DISTINCT split, dialogue_idx FROM fx))),
perm AS (SELECT rank, list_reduce(range(1, least(a * b - n + 1, 64) + 1),
    lambda x, k: CASE WHEN k = 1 OR x >= n THEN {net} ELSE x END, rank) AS dialogue_ord
  FROM dom, generate_series(0, n - 1) AS g(rank))"""


_PERM_SQL = _perm_sql()


@query("corpus_permutation", O.fx_with(_PERM_SQL) + "SELECT rank, dialogue_ord FROM perm")
def q_corpus_permutation(spark, sf):
    return G.corpus_permutation(fx(spark, sf))


@query("fold_sample", O.fx_with(_ORD_SQL, _PERM_SQL) + """
SELECT p.rank, p.dialogue_ord, o.split, o.dialogue_idx
FROM perm p JOIN ords o ON p.dialogue_ord = o.ordinal WHERE p.rank >= 400 AND p.rank < 500""")
def q_fold_sample(spark, sf):
    return G.fold_sample(fx(spark, sf)).select("rank", "dialogue_ord", "split", "dialogue_idx")


def _ratio_sql(items_sql: str, key_sql: str, first_key: str, out_cols: str) -> str:
    items = f"items AS ({items_sql})"
    ranked = (f"ranked AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '273', {key_sql})), "
              f"{first_key}) - 1 AS rank, count(*) OVER () AS n FROM items)")
    return O.fx_with(items, ranked) + f"""
SELECT {out_cols}, CASE WHEN rank < CAST(floor(0.8 * n) AS BIGINT) THEN 'train'
       WHEN rank < CAST(floor(0.8 * n) AS BIGINT) + CAST(floor((n - CAST(floor(0.8 * n) AS BIGINT)) / 2.0) AS BIGINT)
       THEN 'dev' ELSE 'test' END AS part
FROM ranked"""


@query("ratio_split", _ratio_sql("SELECT DISTINCT split, dialogue_idx FROM fx",
                                 "split, CAST(dialogue_idx AS VARCHAR)", "split",
                                 "split, dialogue_idx, rank"))
def q_ratio_split(spark, sf):
    return G.ratio_split(G.dialogues(fx(spark, sf)), ["split", "dialogue_idx"]).select(
        "split", "dialogue_idx", "rank", "part")


@query("oversample", O.fx_with() + """
d AS (SELECT split, dialogue_idx, row_number() OVER (PARTITION BY split ORDER BY dialogue_idx) - 1 AS pos,
             count(*) OVER (PARTITION BY split) AS len FROM (SELECT DISTINCT split, dialogue_idx FROM fx)),
r AS (SELECT *, len + CAST(floor(len * 0.5) AS BIGINT) AS nres FROM d)
SELECT split, dialogue_idx, CAST(c AS INTEGER) AS copy_no, c * len + pos AS result_idx
FROM r, generate_series(0, CAST(ceil((nres - pos) / len) AS BIGINT) - 1) AS g(c)
WHERE pos < nres""".replace("WITH", "WITH", 1).replace("\nd AS", ",\nd AS", 1))
def q_oversample(spark, sf):
    return G.oversample_plan(fx(spark, sf), 0.5)


@query("union_splits", O.fx_with() + """
SELECT split, dialogue_idx, turn_idx FROM fx WHERE split = 'trn' UNION ALL
SELECT split, dialogue_idx, turn_idx FROM fx WHERE split = 'dev' UNION ALL
SELECT split, dialogue_idx, turn_idx FROM fx WHERE split = 'tst' UNION ALL
SELECT split, dialogue_idx, turn_idx FROM fx WHERE split = 'tst-OOV'""")
def q_union_splits(spark, sf):
    from functools import reduce
    from ..sources.corpus import SPLIT_ORDER
    t = fx(spark, sf).select("split", "dialogue_idx", "turn_idx")
    return reduce(lambda a, b: a.unionByName(b), [t.where(F.col("split") == s) for s in SPLIT_ORDER])


PART_SIZE = 100


@query("file_ordinals", O.with_ctes(O.CONV_CTE) + """
SELECT split, split || '.txt.' || CAST(dialogue_idx AS VARCHAR) AS name, text AS content,
       row_number() OVER (ORDER BY list_position(['trn', 'dev', 'tst', 'tst-OOV'], split), dialogue_idx) - 1 AS ordinal
FROM (SELECT dialogue_idx, ['trn', 'dev', 'tst', 'tst-OOV'][dialogue_idx % 4 + 1] AS split,
             string_agg(agent || ':' || chr(9) || text, chr(10) ORDER BY turn_idx) AS text FROM conv GROUP BY dialogue_idx)""")
def q_file_ordinals(spark, sf):
    """A3 over files: every conversation written as a file of its own, listed, ordered and read back."""
    split = F.element_at(F.array(*map(F.lit, SPLIT_ORDER)), (F.col("dialogue_idx") % 4 + 1).cast("int"))
    babble = B.render_babble(conversations(spark, sf))
    path = scratch_path(spark, "one-file-each")
    B.write_dialogue_files(babble.select(F.concat(split, F.lit(".txt."), F.col("dialogue_idx").cast("string")).alias("name"), "text"), path)
    return A.read_dialogue_files(spark, path).select("split", "name", "content", "ordinal")


@query("merge_parts", O.fx_with() + f"""
p AS (SELECT split, dialogue_idx, row_number() OVER (PARTITION BY split ORDER BY dialogue_idx) - 1 AS pos
      FROM (SELECT DISTINCT split, dialogue_idx FROM fx)),
r AS (SELECT split, dialogue_idx, string_agg(agent || ':' || chr(9) || text, chr(10) ORDER BY turn_idx) AS text
      FROM fx GROUP BY split, dialogue_idx)
SELECT split, pos // {PART_SIZE} * {PART_SIZE} AS start, pos // {PART_SIZE} AS part_no, pos AS merged_pos, text
FROM p JOIN r USING (split, dialogue_idx)""".replace("\np AS", ",\np AS", 1))
def q_merge_parts(spark, sf):
    """Partial outputs keyed by their start offset, put back in order with their content."""
    d = G.ordinal_within(B.render_babble(fx(spark, sf)), ["split"], ["dialogue_idx"], "pos")
    start = (F.floor(F.col("pos") / PART_SIZE) * PART_SIZE).cast("bigint")
    parts = d.select("split", start.alias("start"), (F.col("pos") - start).alias("line"), "text")
    return G.merge_parts(parts, ["split"], "start", "line")


@query("calls_not_in_candidates", O.fx_with() + """
SELECT DISTINCT text FROM fx WHERE agent = 'system' AND starts_with(text, 'api_call')
EXCEPT SELECT text FROM fx WHERE agent = 'system' AND split = 'trn'""")
def q_calls_not_in_candidates(spark, sf):
    """D4 with A5: candidates are `k text` lines built from the train answers."""
    t = fx(spark, sf)
    sys_ = t.where(F.col("agent") == "system")
    cand_lines = sys_.where(F.col("split") == "trn").select(
        F.concat_ws(" ", F.abs(F.xxhash64("text")).cast("string"), "text").alias("value"))
    cands = A.parse_candidates(cand_lines).distinct()
    calls = sys_.where(T.is_api_call("text")).select("text").distinct()
    return calls.join(cands, "text", "left_anti")


# ---------------------------------------------------------------- augmentation

from ..operators import augment as AU  # noqa: E402
from ..operators import config_table as CT  # noqa: E402
from ..operators import disfluency_stats as DS  # noqa: E402
from ..operators import tagger as TG  # noqa: E402
from ..operators import pairs as PR  # noqa: E402
from ..sources.config import TOKEN_TYPES, ActionConfig, list_presets  # noqa: E402

SEED = 273
_DEF0 = ActionConfig.preset("default")
MULTI_CONFIGS = ["g2018_corrections_only", "g2018_hesitations_only", "g2018_pp_restarts_only",
                 "g2018_restarts_only"]
REPORT_MULTIPLIERS = [1, 2, 5, 10]
ALL_MULTIPLIERS = [1, 2, 5, 10, 50, 100]
#: Queries of many minutes at sf0.1, which the bench leaves out unless they are named, and without SQL for the same reason.
LONG_QUERIES = {"disfluency_report_all"}
TAGGED_CONFIGS = ["default", "g2018_pp_restarts_only"]


def single_action_config(action: str) -> ActionConfig:
    """A preset reduced to one action (weight kept, or 10 where the preset has 0) and NULL."""
    base = ActionConfig.preset("g2018_pp_restarts_only" if action == "pp_restart" else "default")
    weights = {a: (0 if a not in (action, "NULL") else (base.weights.get(a) or 10))
               for a in base.weights}
    return ActionConfig(f"only_{action}", base.limits, weights, base.masks, base.templates)


def _aug(spark, sf, cfg: ActionConfig, turns=None, vocab=None, **kw):
    turns = fx(spark, sf) if turns is None else turns
    vocab = vocab or _vocab(spark, sf)
    return AU.augment_turns(turns, cfg, vocab, seed=SEED, **kw)


_KEY = ["split", "dialogue_idx", "turn_idx"]


@query("augment_corpus")
def q_augment_corpus(spark, sf):
    """The whole corpus augmented with the default configuration (all turns)."""
    return _aug(spark, sf, ActionConfig.preset("default")).select(
        "split", "dialogue_idx", "copy_no", "turn_idx", "agent", "text")


@query("augment_split")
def q_augment_split(spark, sf):
    """One split augmented with a vocabulary mined from that split only."""
    trn = fx(spark, sf).where(F.col("split") == "trn")
    vocab = V.SlotVocabulary.build(V.slot_values(trn))
    return _aug(spark, sf, ActionConfig.preset("default"), turns=trn, vocab=vocab).select(
        "dialogue_idx", "turn_idx", "agent", "text")


@query("sample_actions")
def q_sample_actions(spark, sf):
    """The action drawn for every token of every augmentable user turn."""
    a = _aug(spark, sf, ActionConfig.preset("default")).where("selected")
    return a.select(*_KEY, F.array_join(AU.sampled_action_list(a), " ").alias("actions"))


@query("augment_utterances")
def q_augment_utterances(spark, sf):
    """rewritten augmentable user turns."""
    return _aug(spark, sf, ActionConfig.preset("default")).where("selected").select(*_KEY, "text")


def _weight_rows() -> list[tuple[str, str, str, float]]:
    """(config_id, token_type, action, first-token weight) of every preset."""
    rows = []
    for name in list_presets():
        cfg = ActionConfig.preset(name)
        for t in TOKEN_TYPES[:3 if cfg.token_types == "three" else 2]:
            for a in cfg.actions:
                can = cfg.limit(a) > 0 and (a == "NULL" or cfg.limit("GLOBAL") > 0)
                rows.append((name, t, a, cfg.base_weight(t, a) if can else 0.0))
    return rows


@query("action_probabilities")
def q_action_probabilities(spark, sf):
    """First-token action probabilities of every preset's token types that occur in the
    corpus, normalised per (configuration, token type); `total` is their sum."""
    weights = spark.createDataFrame(_weight_rows(), "config_id string, token_type string, action string, weight double")
    types = q_token_types(spark, sf).select(F.explode(F.filter(F.split("types", " "), lambda x: x != "")).alias("type")) \
        .groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    # two-type configurations take prepositional starts for background words
    of = F.array(*[F.struct(F.lit(n).alias("config_id"), F.when((F.col("type") == "pp_start") & F.lit(
        ActionConfig.preset(n).token_types == "two"), "background_word").otherwise(F.col("type")).alias("token_type"))
        for n in list_presets()])
    counts = types.select(F.explode(of).alias("c"), "n").groupBy("c.config_id", "c.token_type").agg(
        F.sum("n").cast("bigint").alias("n_tokens"))
    w = Window.partitionBy("config_id", "token_type")
    probs = weights.join(counts, ["config_id", "token_type"]).withColumn(
        "probability", F.col("weight") / F.sum("weight").over(w))
    return probs.select("config_id", "token_type", "action", "probability", "n_tokens",
                        F.round(F.sum("probability").over(w), 9).alias("total"))


def _act_query(action: str):
    def run(spark, sf):
        three = action == "pp_restart"
        a = _aug(spark, sf, single_action_config(action), token_types="three" if three else "two")
        if action == "multiturn_correct":
            return a.select(*_KEY, "orig_turn_idx", "agent", "text")
        return a.where("selected").select(*_KEY, "text")
    run.__name__ = f"q_act_{action}"
    run.__doc__ = f"H: augmentation with `{action}` as the only action."
    return run


for _name, _action in [("act_hesitate", "hesitate"), ("act_correct", "correct"),
                       ("act_correct_long", "correct_long_distance"),
                       ("act_multiturn", "multiturn_correct"), ("act_selfcheck", "selfcheck"),
                       ("act_restart", "restart"), ("act_pp_restart", "pp_restart")]:
    query(_name)(_act_query(_action))


def _tagged_runs(spark, sf) -> DataFrame:
    """Augmentation with tags under three token types: the default and the pp_restart configuration."""
    vocab = _vocab(spark, sf)
    runs = [_aug(spark, sf, ActionConfig.preset(n), vocab=vocab, token_types="three", with_tags=True)
            .where("selected").select(F.lit(n).alias("config_id"), *_KEY, "text", "tags") for n in TAGGED_CONFIGS]
    return runs[0].unionByName(runs[1])


@query("inline_tags")
def q_inline_tags(spark, sf):
    """H9: tags written while generating."""
    return _tagged_runs(spark, sf).withColumn("tags", F.array_join("tags", " "))


@query("augmentation_stats")
def q_augmentation_stats(spark, sf):
    cfg = ActionConfig.preset("default")
    return DS.augmentation_stats(_aug(spark, sf, cfg), cfg)


@query("limit_audit")
def q_limit_audit(spark, sf):
    cfg = ActionConfig.preset("default")
    return DS.limit_audit(_aug(spark, sf, cfg), cfg)


def _pairs(aug: DataFrame) -> DataFrame:
    """I7 on a corpus augmented in the same plan: the original text travels with the row."""
    return aug.where((F.col("agent") == "user") & (F.lower("orig_text") != "<silence>"))


def _stored_pairs(spark, sf) -> DataFrame:
    """The augmented corpus is stored, then paired with the original by position."""
    path = scratch_path(spark, "augmented")
    q_augment_corpus(spark, sf).write.parquet(path)
    return PR.user_pairs(PR.zip_join(spark.read.parquet(path), fx(spark, sf)))


@query("parallel_pairs")
def q_parallel_pairs(spark, sf):
    return _stored_pairs(spark, sf).select(*_KEY, "augmented", "original")


MULTITURN_CONFIG = ActionConfig("default_multiturn", _DEF0.limits, {**_DEF0.weights, "multiturn_correct": 20}, _DEF0.masks, _DEF0.templates)


@query("lineage_pairs")
def q_lineage_pairs(spark, sf):
    """D1 by lineage: a stored corpus with inserted correction turns beside the original, user turns and insertions."""
    path = scratch_path(spark, "augmented-multiturn")
    _aug(spark, sf, MULTITURN_CONFIG).select(
        "split", "dialogue_idx", "copy_no", "turn_idx", "orig_turn_idx", "inserted_rank", "agent", "text").write.parquet(path)
    pairs = PR.lineage_join(spark.read.parquet(path), fx(spark, sf))
    kept = F.col("inserted") | ((F.col("agent") == "user") & (F.lower("original") != "<silence>"))
    return pairs.where(kept).select(*_KEY, "orig_turn_idx", "agent", "augmented", "original", "inserted")


@query("augment_and_count")
def q_augment_and_count(spark, sf):
    """I1 with B7/E8: the augmented corpus written as dialogue files, counted by the writing job, and read back."""
    path = scratch_path(spark, "augmented-files")
    counted = DS.write_counted(_aug(spark, sf, _DEF0), _DEF0, path)
    read = A.read_split_dialogues(spark, path).agg(F.lit("turns_read").alias("metric"), F.count(F.lit(1)).alias("value"))
    return counted.unionByName(read)


@query("multi_config_augment")
def q_multi_config_augment(spark, sf):
    """Every configuration, with its own token types, applied to the whole corpus in one scan, then paired."""
    t = fx(spark, sf).withColumn("orig_text", F.col("text"))
    table = CT.config_table(spark, [ActionConfig.preset(c) for c in MULTI_CONFIGS])
    aug = CT.augment_by_table(t, table, _vocab(spark, sf), seed=SEED)
    return _pairs(aug).select("config_id", *_KEY, F.col("text").alias("augmented"), F.col("orig_text").alias("original"))


def _count_query(kind: str):
    def run(spark, sf):
        cfg = ActionConfig.preset("default")
        vocab = _vocab(spark, sf)
        aug = _aug(spark, sf, cfg, vocab=vocab)
        return DS.count_disfluencies(aug, cfg, vocab, kind)
    run.__name__ = f"q_count_{kind}"
    return run


for _name, _kind in [("count_hesitations", "hesitate"), ("count_restarts", "restart"),
                     ("count_corrections", "correct"), ("count_ld_corrections", "correct_long_distance")]:
    query(_name)(_count_query(_kind))


@query("disfluency_report")
def q_disfluency_report(spark, sf):
    """E7e: statistics of corpora augmented at several sizes (k copies per dialogue).

    Draws are keyed by copy number, so the k-copy corpus is exactly copies 0..k-1 of the
    largest one: the turns that may be rewritten are augmented once for each copy of the largest, the
    others are counted once and multiplied.
    """
    return DS.sliced_report(fx(spark, sf), REPORT_MULTIPLIERS, ActionConfig.preset("default"), _vocab(spark, sf), scratch_path(spark, "report"), seed=SEED)


@query("disfluency_report_all")
def q_disfluency_report_all(spark, sf):
    """E7e at all six sizes, 1 to 100 copies, in slices of ten copies."""
    return DS.sliced_report(fx(spark, sf), ALL_MULTIPLIERS, ActionConfig.preset("default"), _vocab(spark, sf), scratch_path(spark, "report"), seed=SEED)


@query("disfluency_dataset")
def q_disfluency_dataset(spark, sf):
    """One split augmented (vocabulary of that split, three token types) with tags and POS."""
    trn = fx(spark, sf).where(F.col("split") == "trn")
    vocab = V.SlotVocabulary.build(V.slot_values(trn))
    a = _aug(spark, sf, ActionConfig.preset("default"), turns=trn, vocab=vocab, token_types="three",
             with_tags=True).where(F.col("agent") == "user")
    return a.select("dialogue_idx", "turn_idx", F.col("text").alias("utterance"),
                    F.array_join("tags", " ").alias("tags"),
                    F.array_join(T.closed_class_pos(T.tokenize("text")), " ").alias("pos"))


def _tagged(spark, sf):
    cfg = ActionConfig.preset("default")
    t = fx(spark, sf)
    vocab = _vocab(spark, sf)
    prefixes = TG.phrase_prefixes(t, vocab)
    aug = _aug(spark, sf, cfg, turns=t.withColumn("orig_text", F.col("text")), vocab=vocab)
    pairs = _pairs(aug)
    return TG.tag_utterances(pairs, "text", cfg, vocab, prefixes)


@query("tag_disfluencies")
def q_tag_disfluencies(spark, sf):
    """the finite-state tagger over the augmented user turns."""
    return _tagged(spark, sf).select(*_KEY, F.array_join("tags", " ").alias("tags"),
                                     "tag_length_mismatch")


@query("tag_corpus")
def q_tag_corpus(spark, sf):
    """I4 over files: pairs -> parallel CSV (B4) -> read (A6) -> tagger (F5) -> dataset (B6) -> read.
    Utterances whose tags got out of step keep null tags."""
    t, vocab, cfg = fx(spark, sf), _vocab(spark, sf), ActionConfig.preset("default")
    csv, out = scratch_path(spark, "parallel"), scratch_path(spark, "tagged")
    B.write_parallel_csv(_stored_pairs(spark, sf), csv)
    tagged = TG.tag_utterances(A.read_parallel_csv(spark, csv), "augmented", cfg, vocab, TG.phrase_prefixes(t, vocab))
    B.write_tagged(tagged.select(F.col("augmented").alias("utterance"), F.array_join("tags", " ").alias("tags"),
                                 "tag_length_mismatch"), out)
    return spark.read.parquet(out)


@query("render_tagged")
def q_render_tagged(spark, sf):
    """`token|tag` rendering of the generated tags."""
    return _tagged_runs(spark, sf).select("config_id", *_KEY, T.render_tagged(T.tokenize("text"), "tags").alias("rendered"))


@query("distinct_tagged")
def q_distinct_tagged(spark, sf):
    """The set of rendered tagged entries."""
    return q_render_tagged(spark, sf).select("rendered").distinct()


# ---------------------------------------------------------------- oracle SQL for the augmentation queries

from . import oracle_augment as OA  # noqa: E402

_SV_TRN = f"""sv_trn AS (
  SELECT DISTINCT CAST(p - 2 AS INTEGER) AS slot_pos, tokens[p] AS value
  FROM (SELECT {O.tok('text')} AS tokens FROM fx WHERE split = 'trn' AND starts_with(text, 'api_call')),
       generate_series(2, len(tokens)) AS g(p))"""
_FX0 = "fx0 AS (SELECT *, text AS orig_text, 0 AS copy_no FROM fx)"
_FX0_TRN = "fx0_trn AS (SELECT *, 0 AS copy_no FROM fx WHERE split = 'trn')"


def _aug_with(cfg: ActionConfig, turns="fx0", sv="slot_values", prefix="ag", three=False, extra=(), with_tags=False):
    return O.fx_vocab_with(_FX0, _SV_TRN, _FX0_TRN, *extra,
                           *OA.augment_ctes(cfg, turns, sv, prefix, SEED, three=three, with_tags=with_tags))


_DEF = ActionConfig.preset("default")
_SEL = "WHERE selected"
_ACTION_LIST_SQL = ("array_to_string(list_transform(range(n_tokens), lambda k: coalesce("
                    "list_filter(actions, lambda q: q.i = k)[1].action, 'NULL')), ' ')")

ORACLE["augment_corpus"] = _aug_with(_DEF) + \
    "SELECT split, dialogue_idx, copy_no, turn_idx, agent, text FROM ag_out"
ORACLE["augment_split"] = _aug_with(_DEF, turns="fx0_trn", sv="sv_trn") + \
    "SELECT dialogue_idx, turn_idx, agent, text FROM ag_out"
ORACLE["sample_actions"] = _aug_with(_DEF) + \
    f"SELECT split, dialogue_idx, turn_idx, {_ACTION_LIST_SQL} AS actions FROM ag_out {_SEL}"
ORACLE["augment_utterances"] = _aug_with(_DEF) + \
    f"SELECT split, dialogue_idx, turn_idx, text FROM ag_out {_SEL}"


def _tagged_with() -> str:
    ctes = [x for n in TAGGED_CONFIGS for x in OA.augment_ctes(ActionConfig.preset(n), "fx0", "slot_values", f"t_{n}", SEED, three=True, with_tags=True)]
    union = "\nUNION ALL ".join(f"SELECT {O.sql_str(n)} AS config_id, split, dialogue_idx, turn_idx, text, tags FROM t_{n}_out {_SEL}"
                                for n in TAGGED_CONFIGS)
    return O.fx_vocab_with(_FX0, *ctes, f"runs AS ({union})")


ORACLE["inline_tags"] = _tagged_with() + \
    "SELECT config_id, split, dialogue_idx, turn_idx, text, array_to_string(tags, ' ') AS tags FROM runs"

_H4_SQL = """
m AS (SELECT *, lag(ins) OVER w AS prev_ins,
             coalesce(sum(2 * len(ins)) OVER (PARTITION BY split, dialogue_idx, copy_no ORDER BY orig_turn_idx
                                              RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0) AS shift
      FROM ag_out WINDOW w AS (PARTITION BY split, dialogue_idx, copy_no ORDER BY orig_turn_idx))
SELECT split, dialogue_idx, CAST(orig_turn_idx + shift + mm AS INTEGER) AS turn_idx, orig_turn_idx,
       CASE WHEN mm % 2 = 0 THEN agent ELSE 'usr' END AS agent,
       CASE WHEN mm % 2 = 0 THEN text
            ELSE coalesce(prev_ins, []::VARCHAR[])[len(coalesce(prev_ins, []::VARCHAR[])) - (mm - 1) // 2] END AS text
FROM m, generate_series(0, 2 * len(coalesce(prev_ins, []::VARCHAR[]))) AS g(mm)"""

ORACLE["lineage_pairs"] = _aug_with(MULTITURN_CONFIG).rstrip() + "," + _H4_SQL.replace(
    "\nSELECT split", ",\nshifted AS (SELECT mm, orig_text, split").rstrip() + """)
SELECT split, dialogue_idx, turn_idx, orig_turn_idx, agent, text AS augmented,
       CASE WHEN mm = 0 THEN orig_text END AS original, mm > 0 AS inserted
FROM shifted WHERE mm > 0 OR (agent = 'user' AND lower(orig_text) <> '<silence>')"""

for _name, _action in [("act_hesitate", "hesitate"), ("act_correct", "correct"),
                       ("act_correct_long", "correct_long_distance"),
                       ("act_multiturn", "multiturn_correct"), ("act_selfcheck", "selfcheck"),
                       ("act_restart", "restart"), ("act_pp_restart", "pp_restart")]:
    _cfg = single_action_config(_action)
    if _action == "multiturn_correct":
        ORACLE[_name] = _aug_with(_cfg).rstrip() + "," + _H4_SQL
    else:
        ORACLE[_name] = _aug_with(_cfg, three=_action == "pp_restart") + \
            f"SELECT split, dialogue_idx, turn_idx, text FROM ag_out {_SEL}"


def _metric_rows(cfg: ActionConfig) -> str:
    acts = [a for a in cfg.actions if a != "NULL"]
    rows = [
        "SELECT 'dialogues_modified' AS metric, CAST(count(DISTINCT (split, dialogue_idx, copy_no)) "
        "FILTER (WHERE len(actions) > 0) AS BIGINT) AS value FROM sel",
        "SELECT 'utterances_modified', CAST(count(*) FILTER (WHERE len(actions) > 0 OR n_tokens = 0) AS BIGINT) FROM sel",
        "SELECT 'NULL', CAST(coalesce(sum(n_tokens) - sum(len(actions)), 0) AS BIGINT) FROM sel",
    ] + [f"SELECT {O.sql_str(a)}, CAST(coalesce(sum(len(list_filter(actions, lambda q: q.action = {O.sql_str(a)}))), 0) "
         f"AS BIGINT) FROM sel" for a in acts]
    return "\nUNION ALL ".join(rows)


def _audit_rows(cfg: ActionConfig) -> str:
    rows = []
    for a in cfg.actions:
        cnt = "n_tokens - len(actions)" if a == "NULL" else \
            f"len(list_filter(actions, lambda q: q.action = {O.sql_str(a)}))"
        rows.append(f"SELECT {O.sql_str(a)} AS action, CAST(coalesce(max({cnt}), 0) AS BIGINT) AS max_count, "
                    f"CAST({cfg.limit(a)} AS BIGINT) AS action_limit FROM sel")
    return "\nUNION ALL ".join(rows)


ORACLE["augmentation_stats"] = _aug_with(_DEF, extra=()).rstrip() + \
    ",\nsel AS (SELECT * FROM ag_out WHERE selected)\n" + _metric_rows(_DEF)
ORACLE["limit_audit"] = _aug_with(_DEF).rstrip() + \
    ",\nsel AS (SELECT * FROM ag_out WHERE selected)\n" + _audit_rows(_DEF)

ORACLE["augment_and_count"] = ORACLE["augmentation_stats"] + "".join(
    f"\nUNION ALL SELECT '{m}', CAST(count(*) AS BIGINT) FROM ag_out" for m in ("turns_written", "turns_read"))

_PAIRS_WHERE = "WHERE agent = 'user' AND lower(orig_text) <> '<silence>'"
ORACLE["parallel_pairs"] = _aug_with(_DEF) + \
    f"SELECT split, dialogue_idx, turn_idx, text AS augmented, orig_text AS original FROM ag_out {_PAIRS_WHERE}"


def _multi_sql() -> str:
    ctes = []
    for k, c in enumerate(MULTI_CONFIGS):
        cfg = ActionConfig.preset(c)
        ctes += OA.augment_ctes(cfg, "fx0", "slot_values", f"m{k}", SEED, three=cfg.token_types == "three")
    body = "\nUNION ALL ".join(
        f"SELECT {O.sql_str(c)} AS config_id, split, dialogue_idx, turn_idx, text AS augmented, orig_text AS original "
        f"FROM m{k}_out {_PAIRS_WHERE}" for k, c in enumerate(MULTI_CONFIGS))
    return O.fx_vocab_with(_FX0, *ctes) + body


ORACLE["multi_config_augment"] = _multi_sql()


def _trigger_sql(kind: str, cfg: ActionConfig) -> tuple[int, str]:
    """(n, SQL predicate): a trigger of n tokens begins at the 1-based index k of `toks`."""
    def lists(action):
        return "[" + ", ".join(O.sql_str(" ".join(l)) for l in DS.marker_lists(cfg, action)) + "]::VARCHAR[]"
    if kind == "hesitate":
        starts = [t.split()[0] for t in cfg.templates["hesitate"] if t.split()]
        return 2, f"toks[k] IN {_sql_in(starts)} AND toks[k + 1] NOT IN {_sql_in(DS.HESITATION_EXCLUDED_NEXT)}"
    if kind == "restart":
        return 3, f"toks[k] IN {_sql_in(DS.RESTART_FIRST)} AND toks[k + 1] IN {_sql_in(DS.RESTART_SECOND)}"
    m = lists(kind)
    one, two = f"list_contains({m}, toks[k])", f"list_contains({m}, toks[k] || ' ' || toks[k + 1])"
    if kind == "correct":
        return 3, f"({one} AND sl[k + 1]) OR ({two} AND sl[k + 2])"
    return 3, f"({one} AND toks[k + 1] IN {_L_WORDS} AND sl[k + 2]) OR ({two} AND toks[k + 2] IN {_L_WORDS})"


def _hits_sql(kind: str) -> str:
    n, pred = _trigger_sql(kind, _DEF)
    return f"list_filter(range(1, greatest(len(toks) - {n - 2}, 1)), lambda k: {pred})"


def _count_sql(kind: str) -> str:
    n, _ = _trigger_sql(kind, _DEF)
    user = f"(SELECT {O.tok('trim(text)')} AS toks FROM ag_out WHERE agent = 'user')"
    return _aug_with(_DEF).rstrip() + f""",
us AS MATERIALIZED (SELECT toks FROM {user}),
{", ".join(O.flag_ctes("c", "us", "toks"))},
u AS (SELECT list_transform({_hits_sql(kind)}, lambda k: array_to_string(toks[k:k + {n - 1}], ' ')) AS hits
      FROM us LEFT JOIN c_fl USING (toks))
SELECT CAST(sum(len(hits)) AS BIGINT) AS n_triggers, count(*) FILTER (WHERE len(hits) > 0) AS n_turns,
       (SELECT count(DISTINCT h) FROM u, unnest(hits) AS x(h)) AS n_cases,
       count(*) AS n_user_turns,
       CAST(count(*) FILTER (WHERE len(hits) > 0) * 100 AS DOUBLE) / count(*) AS pct_turns
FROM u"""


for _name, _kind in [("count_hesitations", "hesitate"), ("count_restarts", "restart"),
                     ("count_corrections", "correct"), ("count_ld_corrections", "correct_long_distance")]:
    ORACLE[_name] = _count_sql(_kind)


def report_sql(multipliers: list[int]) -> str:
    """Draws are keyed by copy: the k-fold corpus is copies 0 to k - 1 of the largest."""
    top = max(multipliers)
    src = f"cx AS (SELECT fx.*, CAST(c AS INTEGER) AS copy_no FROM fx, generate_series(0, {top - 1}) AS g(c))"
    cols = ", ".join(f"CASE WHEN agent = 'user' THEN len({_hits_sql(k)}) ELSE 0 END AS {k}" for k in DS.KINDS)
    return O.fx_vocab_with(src, *OA.augment_ctes(_DEF, "cx", "slot_values", "r", SEED)) + f""",
rt AS MATERIALIZED (SELECT copy_no, agent, {O.tok('trim(text)')} AS toks FROM r_out),
{", ".join(O.flag_ctes("c", "rt", "toks"))},
x AS (SELECT copy_no, agent, {cols} FROM rt LEFT JOIN c_fl USING (toks)),
y AS (SELECT copy_no, count(*) AS n_turns, count(*) FILTER (WHERE agent = 'user') AS n_user_turns,
             {', '.join(f'sum({k}) AS n_{k}, count(*) FILTER (WHERE {k} > 0) AS turns_{k}' for k in DS.KINDS)}
      FROM x GROUP BY copy_no),
sizes(k) AS (VALUES {', '.join(f'({k})' for k in multipliers)})
SELECT k || 'x' AS corpus, CAST(sum(n_turns) AS BIGINT) AS n_turns, CAST(sum(n_user_turns) AS BIGINT) AS n_user_turns,
       {', '.join(f'CAST(sum(n_{k}) AS BIGINT) AS n_{k}' for k in DS.KINDS)},
       {', '.join(f'CAST(sum(turns_{k}) AS BIGINT) AS turns_{k}' for k in DS.KINDS)}
FROM sizes JOIN y ON y.copy_no < sizes.k GROUP BY k"""


ORACLE["disfluency_report"] = report_sql(REPORT_MULTIPLIERS)

_POS_SQL = (f"array_to_string(list_transform({O.tok('text')}, lambda x: CASE WHEN x IN {_sql_in(T.PREPOSITIONS)} "
            f"THEN 'IN' WHEN x IN {_sql_in(T.DETERMINERS)} THEN 'DT' ELSE 'X' END), ' ')")
ORACLE["disfluency_dataset"] = _aug_with(_DEF, turns="fx0_trn", sv="sv_trn", three=True, with_tags=True) + f"""
SELECT dialogue_idx, turn_idx, text AS utterance, array_to_string(tags, ' ') AS tags, {_POS_SQL} AS pos
FROM ag_out WHERE agent = 'user'"""

_RENDER_SQL = (f"(SELECT config_id, split, dialogue_idx, turn_idx, array_to_string(list_transform(range(least(len(tk), len(tags))), "
               f"lambda k: tk[k + 1] || '|' || tags[k + 1]), ' ') AS rendered "
               f"FROM (SELECT *, {O.tok('text')} AS tk FROM runs))")
ORACLE["render_tagged"] = _tagged_with() + f"SELECT * FROM {_RENDER_SQL}"
ORACLE["distinct_tagged"] = _tagged_with() + f"SELECT DISTINCT rendered FROM {_RENDER_SQL}"


def _prob_sql() -> str:
    rows = ", ".join(f"({O.sql_str(c)}, {O.sql_str(t)}, {O.sql_str(a)}, {OA._d(w)})" for c, t, a, w in _weight_rows())
    two = _sql_in([n for n in list_presets() if ActionConfig.preset(n).token_types == "two"])
    return O.fx_vocab_with(*_USER_FL, f"w(config_id, token_type, action, weight) AS (VALUES {rows})") + f"""
, kinds AS (SELECT CASE WHEN sl[i] THEN 'slot_value' WHEN toks[i] IN {_sql_in(T.PREPOSITIONS)} AND toks[i] <> 'like'
                   THEN 'pp_start' ELSE 'background_word' END AS kind, count(*) AS n
            FROM (SELECT * FROM {_USER_TOKS}) t, generate_series(1, len(toks)) AS g(i) GROUP BY 1)
, cnt AS (SELECT config_id, CASE WHEN kind = 'pp_start' AND config_id IN {two} THEN 'background_word' ELSE kind END AS token_type,
                 CAST(sum(n) AS BIGINT) AS n_tokens
          FROM kinds, (SELECT DISTINCT config_id FROM w) GROUP BY 1, 2)
SELECT config_id, token_type, action, probability, n_tokens,
       round(sum(probability) OVER (PARTITION BY config_id, token_type), 9) AS total
FROM (SELECT w.config_id, w.token_type, w.action, cnt.n_tokens,
             w.weight / sum(w.weight) OVER (PARTITION BY w.config_id, w.token_type) AS probability
      FROM w JOIN cnt USING (config_id, token_type))"""


ORACLE["action_probabilities"] = _prob_sql()


def _tagger_sql(final: str) -> str:
    """Each distinct delexicalised utterance is tagged once."""
    phrase = _sql_phrase("toks", "i")
    for_words = phrase.replace("array_to_string(toks[", f"array_to_string(({O.delex()})[", 1)
    phr = f"phr AS MATERIALIZED (SELECT list(DISTINCT string_split({for_words}, ' ')) AS P " \
          "FROM al_fl, generate_series(1, len(toks)) AS g(i) WHERE sl[i])"
    tg = OA.tagger_sql("dx", TG.markers(_DEF), "P")
    return _aug_with(_DEF, extra=(*_ALL_FL, phr)).rstrip() + f""",
pairs AS MATERIALIZED (SELECT *, {O.tok('text')} AS tk FROM ag_out {_PAIRS_WHERE}),
{", ".join(O.flag_ctes("p", "pairs", "tk"))},
delexed AS MATERIALIZED (SELECT split, dialogue_idx, turn_idx, text, tk, {O.delex('tk')} AS dx FROM pairs JOIN p_fl ON tk = p_fl.toks),
tags_of AS MATERIALIZED (SELECT dx, {tg} AS tg FROM (SELECT DISTINCT dx FROM delexed), phr),
tagged AS (SELECT * FROM delexed JOIN tags_of USING (dx))
{final}"""


_TAGS_SQL = "CASE WHEN len(tg) = len(tk) THEN array_to_string(tg, ' ') END AS tags, len(tg) <> len(tk) AS tag_length_mismatch"
ORACLE["tag_disfluencies"] = _tagger_sql(f"SELECT split, dialogue_idx, turn_idx, {_TAGS_SQL} FROM tagged")
ORACLE["tag_corpus"] = _tagger_sql(f"SELECT text AS utterance, {_TAGS_SQL} FROM tagged")


@query("read_permutation", O.fx_with(_PERM_SQL) + "SELECT rank, dialogue_ord FROM perm")
def q_read_permutation(spark, sf):
    """A9 round trip: the corpus permutation written as one `;`-separated line, read back by byte ranges."""
    path = scratch_path(spark, "permutation")
    B.write_permutation(G.corpus_permutation(fx(spark, sf)), path)
    return A.read_permutation(spark, path)


_ECHO_KEY = "split, CAST(dialogue_idx AS VARCHAR), CAST(turn_idx AS VARCHAR)"


@query("echo_dataset", O.fx_with(_FREQ_SQL, _THR_SQL, """items AS (
  SELECT t.split, t.dialogue_idx, t.turn_idx, t.text
  FROM fx t JOIN freq f ON t.split = f.split AND t.text = f.text JOIN thr h ON t.split = h.split
  WHERE t.agent = 'user' AND f.freq < h.threshold)""", f"""ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '273', {_ECHO_KEY})), split) - 1 AS rank,
         count(*) OVER () AS n FROM items)""") + """
SELECT split, dialogue_idx, turn_idx, rank, text AS encoder, text AS decoder,
       CASE WHEN rank < CAST(floor(0.8 * n) AS BIGINT) THEN 'train'
            WHEN rank < CAST(floor(0.8 * n) AS BIGINT) + CAST(floor((n - CAST(floor(0.8 * n) AS BIGINT)) / 2.0) AS BIGINT)
            THEN 'dev' ELSE 'test' END AS part
FROM ranked""")
def q_echo_dataset(spark, sf):
    """User turns below their split's 95th-percentile text frequency, shuffled and split
    0.8 / 0.1 / 0.1 exactly; the encoder and decoder sides are the same text."""
    items = S.infrequent_turns(fx(spark, sf)).select("split", "dialogue_idx", "turn_idx", "text")
    r = G.ratio_split(items, ["split", "dialogue_idx", "turn_idx"])
    return r.select("split", "dialogue_idx", "turn_idx", "rank", F.col("text").alias("encoder"),
                    F.col("text").alias("decoder"), "part")


@query("echo_pair_files", "SELECT part, rank, encoder, decoder FROM (" + ORACLE["echo_dataset"] + ") e")
def q_echo_pair_files(spark, sf):
    """I6 to files (B5): the echo dataset as encoder and decoder files of train, dev and test, read back line by line."""
    path = scratch_path(spark, "echo")
    numbered = F.concat_ws(" ", F.col("rank").cast("string"), "encoder")
    r = q_echo_dataset(spark, sf).select("part", "rank", numbered.alias("encoder"), "decoder")
    sizes = B.write_dataset_files(r, path, "part", ["rank"])
    back = A.read_dataset_files(spark, path, sizes, "part")
    return back.select("part", F.substring_index("encoder", " ", 1).cast("bigint").alias("rank"),
                       F.regexp_replace("encoder", r"^\d+ ", "").alias("encoder"), "decoder")


@query("context_pair_files", "SELECT split, encoder, decoder FROM (" + ORACLE["corpus_context_windows"] + ") c")
def q_context_pair_files(spark, sf):
    """I8 to files (B5): encoder and decoder files of every split, read back line by line."""
    path = scratch_path(spark, "seq2seq")
    names = B.write_dataset_files(q_corpus_context_windows(spark, sf), path, "split", ["dialogue_idx", "turn_idx"])
    return A.read_dataset_files(spark, path, names, "split").select("split", "encoder", "decoder")


@query("overwrite_dialogues", ORACLE["parse_dialogues"].replace("agent, text\n", "agent, replace(text, 'are looking', 'are you looking') AS text\n", 1))
def q_overwrite_dialogues(spark, sf):
    """A folder of dialogue files is written twice; only what was written last is read back."""
    path = _written_corpus(spark, sf)
    cleaned = fx(spark, sf).withColumn("text", T.clean_text("text", _CLEAN))
    B.write_dialogue_text(cleaned, path)
    return A.read_split_dialogues(spark, path).select("split", "dialogue_no", "turn_idx", "agent", "text")


# the cheap queries come first: a comparison that runs out of time has then covered most of them
for _name in ["action_probabilities", "act_restart", "act_hesitate", "act_selfcheck", "act_correct", "act_pp_restart",
              "act_correct_long", "act_multiturn", "limit_audit", "augmentation_stats", "augment_split", "augment_corpus",
              "augment_utterances", "sample_actions", "parallel_pairs", "disfluency_dataset", "count_hesitations",
              "count_restarts", "count_corrections", "count_ld_corrections", "tag_corpus", "tag_disfluencies",
              "inline_tags", "render_tagged", "distinct_tagged", "multi_config_augment", "disfluency_report", "disfluency_report_all"]:
    QUERIES[_name] = QUERIES.pop(_name)
