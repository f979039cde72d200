"""Licence scan by sentence rules, in DataFrame functions only.

A text is put in lower case (A-Z), everything but letters, digits, dots, plus signs and sentence
ends becomes a space, and it is cut into sentences.  Each sentence that matches a known licence
sentence (`license_rules.SENTENCES`) becomes that sentence's identifier, the others are skipped, and
the sequence of identifiers is matched against the ordered rules (`license_rules.RULES`): a rule
that finds its identifiers next to each other reports its licence and takes them out, so that
longer rules come before the notices they contain.

Everything is one narrow, row-wise plan: no shuffle, no state, whole texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import read_table
from parlance.llm.license_rules import RULES, SENTENCES, TRIGGERS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANY_TRIGGER = "(" + "|".join(TRIGGERS) + ")"


def sentences(text: Column) -> Column:
    """Normalised sentences of a text; a sentence ends at . ! ? ; or : before white space."""
    t = F.concat(F.translate(text, UPPER, LOWER), F.lit(" "))
    t = F.regexp_replace(t, "[^a-z0-9.!?;:+]+", " ")
    t = F.regexp_replace(t, "[.!?;:]+ ", "|")
    t = F.regexp_replace(t, "[ !?;:]+", " ")
    return F.transform(F.split(t, "[|]"), lambda s: F.trim(s))


def identifier(sentence: Column) -> Column:
    """The first sentence identifier whose pattern is found; null for other sentences."""
    return F.coalesce(*(F.when(sentence.rlike(pattern), F.lit(name)) for name, pattern in SENTENCES))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_sentences) of every row.

    sentence_ids: identifiers in the text's order; licenses: in the rules' order, each once;
    n_sentences: recognised sentences.  Texts without licence sentences (null and empty ones among
    them) have empty arrays.  Repeated rows and null ids give rows of their own.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    low = F.lower("text")
    # the words of a trigger may be apart in the raw text (a line end, spaces): its longest word is looked for
    words = dict.fromkeys(max(t.split(), key=len) for t in TRIGGERS)
    hint = reduce(lambda a, b: a | b, (low.contains(t) for t in words))
    # texts without any trigger word stop here; the others drop their plain sentences first
    found = base.withColumn("known", F.when(hint, F.filter(sentences(F.col("text")), lambda s: s.rlike(ANY_TRIGGER)))) \
        .select("doc_id", F.when(F.size("known") > 0, F.filter(
            F.transform("known", identifier), lambda i: i.isNotNull())).alias("ids"))
    found = found.select("doc_id", F.coalesce("ids", F.array().cast("array<string>")).alias("sentence_ids"))
    left = F.when(F.size("sentence_ids") > 0,
                  F.concat(F.lit("<"), F.array_join("sentence_ids", "><"), F.lit(">"))).otherwise("")
    hits = []
    for license_, rule in RULES:
        key = "".join(f"<{name}>" for name in rule)
        hits.append(F.when(left.contains(key), F.lit(license_)))
        left = F.replace(left, F.lit(key), F.lit(""))
    licenses = F.when(F.size("sentence_ids") > 0, F.array_distinct(F.array_compact(F.array(*hits)))) \
        .otherwise(F.array().cast("array<string>"))
    return found.select("doc_id", "sentence_ids", licenses.alias("licenses"),
                        F.size("sentence_ids").cast("long").alias("n_sentences"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan_licenses(read_table(spark, sf_dir, "documents"))
    return s.select("doc_id", F.array_join("sentence_ids", " ").alias("sentence_ids"),
                    F.array_join("licenses", " ").alias("licenses"), "n_sentences")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same result in DuckDB SQL: one row per sentence, then one fold over the rules."""
    cases = "\n".join(f"        WHEN regexp_matches(s, {_quoted(p)}) THEN {_quoted(n)}" for n, p in SENTENCES)
    rules = ", ".join(f"{{'l': {_quoted(lic)}, 'k': {_quoted(''.join(f'<{n}>' for n in rule))}}}" for lic, rule in RULES)
    return f"""
WITH cut AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(regexp_replace(regexp_replace(regexp_replace(
           translate(coalesce(text, ''), '{UPPER}', '{LOWER}') || ' ',
           '[^a-z0-9.!?;:+]+', ' ', 'g'), '[.!?;:]+ ', '|', 'g'), '[ !?;:]+', ' ', 'g'), '|') AS parts
  FROM documents),
each AS (
  SELECT doc_id, r, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM cut),
named AS (
  SELECT doc_id, r, n, CASE
{cases}
        END AS id
  FROM (SELECT doc_id, r, n, trim(part, ' ') AS s FROM each) WHERE regexp_matches(s, {_quoted(ANY_TRIGGER)})),
seq AS (
  SELECT r, list(id ORDER BY n) AS ids FROM named WHERE id IS NOT NULL GROUP BY r),
folded AS (
  SELECT r, ids, list_reduce([{rules}],
      lambda acc, x: {{'left': replace(acc.left, x.k, ''),
                       'hits': CASE WHEN contains(acc.left, x.k) AND NOT list_contains(acc.hits, x.l)
                                    THEN list_append(acc.hits, x.l) ELSE acc.hits END}},
      {{'left': '<' || array_to_string(ids, '><') || '>', 'hits': CAST([] AS VARCHAR[])}}) AS f
  FROM seq)
SELECT c.doc_id AS doc_id, coalesce(array_to_string(ids, ' '), '') AS sentence_ids,
       coalesce(array_to_string(f.hits, ' '), '') AS licenses, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_sentences
FROM cut c LEFT JOIN folded USING (r)"""
