"""DuckDB SQL building blocks for the oracle side of the correctness check.

The oracle is independent SQL over the same parquet tables: the `fx` corpus CTE, the
tokeniser, the md5 draw and plain relational queries.
"""

from __future__ import annotations

FX_CTE = """
fx_d AS (
  SELECT o_orderkey AS dialogue_idx,
         lower(c_mktsegment) AS cuisine, lower(n_name) AS loc,
         CASE o_orderkey % 4 WHEN 0 THEN 'two' WHEN 1 THEN 'four' WHEN 2 THEN 'six' ELSE 'eight' END AS party,
         CASE WHEN o_totalprice < 150000 THEN 'cheap' WHEN o_totalprice < 350000 THEN 'moderate' ELSE 'expensive' END AS price,
         CASE WHEN n_nationkey >= 20 THEN 'tst-OOV' WHEN o_orderkey % 10 < 7 THEN 'trn'
              WHEN o_orderkey % 10 < 8 THEN 'dev' ELSE 'tst' END AS split
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
fx_k AS (SELECT 0 AS turn_idx UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3
         UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7),
fx AS (
  SELECT split, dialogue_idx, split || '.' || CAST(dialogue_idx AS VARCHAR) AS dialogue_id, turn_idx,
   CASE WHEN turn_idx % 2 = 0 THEN 'user' ELSE 'system' END AS agent,
   CASE turn_idx
    WHEN 0 THEN CASE dialogue_idx % 3 WHEN 0 THEN 'hello' WHEN 1 THEN 'hi' ELSE 'good morning' END
    WHEN 1 THEN 'hello what can i help you with today'
    WHEN 2 THEN CASE WHEN dialogue_idx % 2 = 0
       THEN concat('can you book a table in ', loc, ' with ', cuisine, ' cuisine for ', party, ' people in a ', price, ' price range please')
       ELSE concat('may i have a table for ', party, ' people with ', cuisine, ' food in ', loc) END
    WHEN 3 THEN CASE WHEN dialogue_idx % 2 = 0 THEN 'i am on it' ELSE 'which price range are looking for' END
    WHEN 4 THEN CASE WHEN dialogue_idx % 2 = 0 THEN '<SILENCE>' ELSE concat('in a ', price, ' price range please') END
    WHEN 5 THEN 'ok let me look into some options for you'
    WHEN 6 THEN '<SILENCE>'
    ELSE concat('api_call ', cuisine, ' ', loc, ' ', party, ' ', price) END AS text
  FROM fx_d CROSS JOIN fx_k)
"""

CONV_CTE = """
conv AS (
  SELECT 'conv' AS split, CAST(conv_id AS BIGINT) AS dialogue_idx,
         'conv.' || CAST(conv_id AS VARCHAR) AS dialogue_id, CAST(turn AS INTEGER) AS turn_idx,
         role AS agent, text
  FROM conversations)
"""

VOCAB_CTE = """
fx_calls AS (SELECT {tok} AS tokens FROM fx WHERE starts_with(text, 'api_call')),
slot_values AS (
  SELECT DISTINCT CAST(p - 2 AS INTEGER) AS slot_pos, tokens[p] AS value
  FROM fx_calls, generate_series(2, len(tokens)) AS g(p)),
vocab AS (SELECT DISTINCT value FROM slot_values)
"""


def tok(expr: str) -> str:
    """Whitespace tokeniser (no empty tokens)."""
    return f"list_filter(string_split_regex({expr}, '\\s+'), lambda x: x <> '')"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def fx_with(*more: str) -> str:
    return with_ctes(FX_CTE, *more)


def fx_vocab_with(*more: str) -> str:
    return with_ctes(FX_CTE, VOCAB_CTE.format(tok=tok("text")), *more)


def uniform(*parts: str) -> str:
    """SQL twin of `functions.rng.uniform`; each part is an SQL expression."""
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(('0x' || substr(md5(concat_ws('|', {joined})), 1, 8))::BIGINT / 4294967296.0)"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(sql_str(x) for x in items) + "]"


def flag_ctes(prefix: str, source: str, toks: str, vocab: str = "vocab") -> list[str]:
    """CTE `{prefix}_fl(toks, sl)`: per distinct non-empty token list of `source` whether each token is
    in `vocab(value)`.  A join instead of a list that lambdas capture."""
    return [f"""{prefix}_ex AS (
  SELECT toks, unnest(toks) AS w, generate_subscripts(toks, 1) AS i FROM (SELECT DISTINCT {toks} AS toks FROM {source}))""",
            f"""{prefix}_fl AS MATERIALIZED (
  SELECT e.toks, list(v.value IS NOT NULL ORDER BY e.i) AS sl
  FROM {prefix}_ex e LEFT JOIN (SELECT DISTINCT value FROM {vocab}) v ON e.w = v.value GROUP BY e.toks)"""]


def delex(toks: str = "toks", sl: str = "sl") -> str:
    return f"list_transform({toks}, lambda x, ix: CASE WHEN {sl}[ix] THEN '<value>' ELSE x END)"
