"""Slot-value vocabulary mined from `api_call …` turns, and what derives from it.

The vocabulary is a distinct aggregation (one shuffle, map-side partial distinct).  Operators ask
two things of it: which tokens of an utterance are slot values (`annotate`), and a random
confusable value of a token (`wrong_value` / `draw_wrong_values`).  There are two plans with equal
results:

* up to `INLINE_VALUES` values they are literals (`isin` becomes a hash-set lookup in generated
  code; no join, no shuffle);
* beyond it nothing reaches the driver: distinct token lists are exploded, joined with the
  vocabulary table and put together again, and each draw is a join on (signature, rank).  AQE
  broadcasts the vocabulary when it is small and splits hot keys when it is not.

Values that share a slot position are confusable.  They are ranked once per position signature;
a draw among the n - 1 others is an index that skips the word's own rank.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_api_call, let, phrase_bounds, tokenize
from ..session import scratch_path
from .ordinals import ordinal_within

#: Vocabularies of more values are joined instead of inlined; either plan works for any size.
INLINE_VALUES = 1_000
VALUE = "<value>"
#: Up to so many position signatures are told apart by hash sets, one after the other.
FEW_SIGNATURES = 16


def slot_values(turns: DataFrame) -> DataFrame:
    """Distinct (slot_pos, value) of api-call arguments (any agent, prefix match)."""
    calls = turns.where(is_api_call("text")).select(tokenize("text").alias("tokens"))
    args = calls.select(F.posexplode(F.slice("tokens", 2, 1 << 30)).alias("slot_pos", "value"))
    return args.select(F.col("slot_pos").cast("int"), "value").distinct()


def slot_vocabulary(turns: DataFrame) -> DataFrame:
    """The flat vocabulary, one row per distinct value."""
    return slot_values(turns).select("value").distinct()


def _stored(df: DataFrame, tag: str) -> DataFrame:
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class SlotVocabulary:
    """The vocabulary as literals (`positions`, `by_pos`) or, when larger, as tables."""

    positions: dict[str, list[int]] = field(default_factory=dict)  # value -> slot positions
    by_pos: dict[int, list[str]] = field(default_factory=dict)  # slot position -> sorted values
    words: DataFrame | None = None  # (value, sig, own_rank, n): joined plan only
    ranked: DataFrame | None = None  # (sig, rank, wrong): the confusable values of a signature

    @classmethod
    def build(cls, slot_values_df: DataFrame, inline_values: int | None = None) -> "SlotVocabulary":
        """Literals if there are few values, else stored tables."""
        most = INLINE_VALUES if inline_values is None else inline_values
        pairs = _stored(slot_values_df, "slot-values")
        if pairs.select("value").distinct().limit(most + 1).count() <= most:
            vocab = cls()
            for r in pairs.groupBy("value").agg(F.array_sort(F.collect_set("slot_pos")).alias("p")).collect():
                vocab.positions[r["value"]] = list(r["p"])
                for p in r["p"]:
                    vocab.by_pos.setdefault(p, []).append(r["value"])
            for p in vocab.by_pos:
                vocab.by_pos[p].sort()
            return vocab
        sig = _stored(signatures(pairs), "signatures")
        union = signature_members(sig, pairs)
        ranked = _stored(ordinal_within(union, ["sig"], ["member"], "rank"), "ranked-values")
        sizes = ranked.groupBy("sig").agg(F.count(F.lit(1)).cast("int").alias("n"))
        words = sig.select("value", "sig").join(
            ranked.withColumnRenamed("member", "value"), ["sig", "value"]).join(sizes, "sig").select(
            "value", "sig", F.col("rank").cast("int").alias("own_rank"), "n")
        return cls(words=_stored(words, "slot-words"),
                   ranked=ranked.select("sig", F.col("rank").cast("int").alias("rank"), F.col("member").alias("wrong")))

    @property
    def inlined(self) -> bool:
        return self.words is None

    @property
    def values(self) -> list[str]:
        return sorted(self.positions)

    # -- literal plan

    def is_slot(self, token: Column) -> Column:
        vals = self.values
        return token.isin(vals) if vals else F.lit(False)

    def _signatures(self) -> tuple[dict[str, list[int]], list[list[str]]]:
        """value -> [signature number, own rank]; the ranked values of each signature."""
        numbers: dict[tuple[int, ...], int] = {}
        unions: list[list[str]] = []
        of: dict[str, list[int]] = {}
        for v in self.values:
            key = tuple(self.positions[v])
            if key not in numbers:
                numbers[key] = len(unions)
                unions.append(sorted({w for p in key for w in self.by_pos[p]}))
            of[v] = [numbers[key], unions[numbers[key]].index(v)]
        return of, unions

    def wrong_value(self, token: Column, u: Column) -> Column:
        """A confusable value of `token` by the draw u; null where there is none (D3)."""
        of, unions = self._signatures()
        if not of:
            return F.lit(None).cast("string")
        if len(unions) <= FEW_SIGNATURES:
            # the values of a signature are sorted, so that a word's own place among them is told by comparing
            named: dict[int, list[str]] = {}
            for v, (number, _) in of.items():
                named.setdefault(number, []).append(v)

            def other(members: list[str]) -> Column:
                values = F.array(*[F.lit(m) for m in members])
                if len(members) < 2:
                    return F.lit(None).cast("string")
                return let(F.floor(u * (len(members) - 1)).cast("int"), lambda j: F.when(
                    F.get(values, j) < token, F.get(values, j)).otherwise(F.get(values, j + 1)))

            told = None
            for number, words in sorted(named.items()):
                told = (F if told is None else told).when(token.isin(words), other(unions[number]))
            return told
        place = F.element_at(F.from_json(F.lit(json.dumps(of, sort_keys=True)), "map<string,array<int>>"), token)
        lists = F.from_json(F.lit(json.dumps(unions)), "array<array<string>>")

        def pick(p: Column) -> Column:
            members = F.element_at(lists, p[0] + 1)
            return F.when(F.size(members) > 1, F.element_at(members, other_rank(u, F.size(members), p[1]) + 1))

        return F.element_at(F.transform(F.array(place), lambda p: F.when(p.isNotNull(), pick(p))), 1)

    # -- either plan

    def annotate(self, df: DataFrame, tokens: str, out: str = "_slot") -> DataFrame:
        """Adds `out`: for each token of the array column whether it is a slot value."""
        if self.inlined:
            return df.withColumn(out, F.transform(tokens, self.is_slot))
        marks = self.joined(df, tokens).select(
            F.col("_key"), F.transform("_words", lambda w: w["sig"].isNotNull()).alias(out))
        # a null or empty list has no key to meet
        return df.join(marks, F.col(tokens) == F.col("_key"), "left").drop("_key").withColumn(
            out, F.coalesce(out, F.array().cast("array<boolean>")))

    def joined(self, df: DataFrame, tokens: str) -> DataFrame:
        """Distinct token lists with (sig, own_rank, n) of each token, nulls for plain tokens."""
        lists = df.select(F.col(tokens).alias("_key")).where(F.size("_key") > 0).distinct()
        ex = lists.select("_key", F.posexplode("_key").alias("_i", "value"))
        hit = ex.join(self.words, "value", "left")
        found = hit.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_i", "sig", "own_rank", "n"))).alias("_words"))
        return _stored(found, "token-lists")

    def draw_wrong_values(self, df: DataFrame, tokens: str, picks: str, draw_key: list[str], u_of, wants) -> DataFrame:
        """Joined plan: `picks` (array<struct<i,a>>) becomes array<struct<i,a,slot,wrong>>.

        `u_of(i)` is the draw for token i, from the columns `draw_key`; `wants(a)` says which actions need a value.  The rows get
        an id of their own when they are stored, so that equal rows and null keys stay apart.  Only
        rows with picks take part in the joins.
        """
        df = _stored(df.withColumn("_row", F.monotonically_increasing_id()), "picks")
        words = self.joined(df.where(F.size(picks) > 0), tokens)
        ask = df.where(F.size(picks) > 0).join(words, F.col(tokens) == F.col("_key")).select(
            "_row", *draw_key, F.explode(picks).alias("_p"), "_words").select(
            "_row", *draw_key, "_p", F.element_at("_words", F.col("_p.i") + 1).alias("_w"))
        ask = ask.select("_row", "_p", F.col("_w.sig").alias("sig"), F.when(
            wants(F.col("_p.a")) & (F.col("_w.n") > 1),
            other_rank(u_of(F.col("_p.i")), F.col("_w.n"), F.col("_w.own_rank"))).alias("rank"))
        told = ask.join(self.ranked, ["sig", "rank"], "left").groupBy("_row").agg(
            F.array_sort(F.collect_list(F.struct(F.col("_p.i").alias("i"), F.col("_p.a").alias("a"),
                                                 F.col("sig").isNotNull().alias("slot"), "wrong"))).alias("_told"))
        kind = "array<struct<i:int,a:int,slot:boolean,wrong:string>>"
        return df.join(told, "_row", "left").withColumn(picks, F.coalesce("_told", F.array().cast(kind))).drop("_told", "_row")


def other_rank(u: Column, n: Column, own: Column) -> Column:
    """0-based rank among n of a uniform draw that is never `own` (n > 1)."""
    j = F.floor(u * (n - 1)).cast("int")
    return (j + F.when(j >= own, 1).otherwise(0)).cast("int")


def delexicalized(tokens: str, slots: str = "_slot") -> Column:
    """The token array with `<value>` for slot values."""
    return F.zip_with(tokens, slots, lambda t, s: F.when(s, F.lit(VALUE)).otherwise(t))


def slot_value_tokens(turns: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tokens of every turn that are slot values, as a (left-semi) join.

    The join keeps working for a vocabulary of any size; AQE broadcasts it when small.
    """
    toks = turns.select("split", "dialogue_idx", "turn_idx",
                        F.posexplode(tokenize("text")).alias("token_idx", "token"))
    return toks.join(vocab.select(F.col("value").alias("token")), "token", "left_semi")


def slot_phrases(turns: DataFrame, vocab: SlotVocabulary, delexicalize: bool = False) -> DataFrame:
    """Distinct enclosing phrases (C10) of every slot-value token in every turn; with
    `delexicalize` slot values read `<value>`."""
    texts = turns.select(tokenize("text").alias("tokens")).distinct()
    t = vocab.annotate(texts, "tokens")
    idx = t.select("tokens", "_slot", F.posexplode("_slot").alias("i", "hit")).where("hit")
    b = phrase_bounds("tokens", F.col("i"))
    words = delexicalized("tokens") if delexicalize else F.col("tokens")
    return idx.select(F.array_join(F.slice(words, b["begin"] + 1, b["end"] - b["begin"] + 1), " ")
                      .alias("phrase")).distinct()


def signatures(slot_values_df: DataFrame) -> DataFrame:
    """(value, positions, sig): each value's sorted slot positions and their hash."""
    s = slot_values_df.groupBy("value").agg(F.array_sort(F.collect_set("slot_pos")).alias("positions"))
    return s.withColumn("sig", F.xxhash64("positions"))


def signature_members(sig: DataFrame, slot_values_df: DataFrame) -> DataFrame:
    """(sig, member): all values at any position of a signature.  There are few signatures; the
    value side is split by AQE where it is large."""
    places = sig.select("sig", "positions").distinct().select("sig", F.explode("positions").alias("slot_pos"))
    return slot_values_df.join(places, "slot_pos").select("sig", F.col("value").alias("member")).distinct()


def confusable_values(slot_values_df: DataFrame) -> DataFrame:
    """D3: (positions, confusable, n_values): the values that can stand in for the `n_values` values
    of each position signature.  A value is confusable with all members of its signature but
    itself; the membership is linear in the vocabulary, the pairs would not be.
    """
    sig = signatures(slot_values_df)
    names = sig.groupBy("sig", "positions").agg(F.count(F.lit(1)).alias("n_values")).select(
        "sig", "n_values", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))
    return signature_members(sig, slot_values_df).join(names, "sig").select(
        "positions", F.col("member").alias("confusable"), "n_values")
