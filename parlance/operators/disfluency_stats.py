"""Disfluency statistics of a corpus (E7a-E7e) and of an augmentation run.

A trigger is tested at each token index of a user turn, on the bound token array; counts are
aggregations over the hits.  No n-gram arrays, no per-turn Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.text import PHRASE_LEFT_WORDS, in_set, is_silence, let, tokenize
from ..session import scratch_path
from ..sinks.dialogue_text import write_dialogue_text
from ..sources.config import ActionConfig
from .augment import augment_turns
from .ordinals import oversample
from .vocab import SlotVocabulary

# The restart trigram test (first word, second word) of the statistics.
RESTART_FIRST = ["uhm", "sorry"]
RESTART_SECOND = ["yeah"]
# Second words that do not count as a hesitation.
HESITATION_EXCLUDED_NEXT = ["sorry", "yeah"]


def marker_lists(cfg: ActionConfig, action: str) -> list[list[str]]:
    """Templates of `action` with `$…` operands removed (C13), in template order."""
    return [[t for t in tmpl.split() if not t.startswith("$")] for tmpl in cfg.templates.get(action, [])]


def _marker_is(words: list[Column], lists: list[list[str]]) -> Column:
    """The given tokens equal one of the literal marker lists of the same length.

    Tokens never contain whitespace, so list equality is equality of the space-joined
    strings: a hash-set lookup instead of array comparisons."""
    keys = sorted({" ".join(l) for l in lists if len(l) == len(words)})
    if not keys:
        return F.lit(False)
    return F.concat_ws(" ", *words).isin(keys)


def first_words(kind: str, cfg: ActionConfig) -> list[str]:
    """The words a trigger of `kind` can begin with."""
    if kind == "restart":
        return RESTART_FIRST
    if kind == "hesitate":
        return sorted({t.split()[0] for t in cfg.templates.get("hesitate", []) if t.split()})
    return sorted({m[0] for m in marker_lists(cfg, kind) if m})


def trigger_matches(kind: str, cfg: ActionConfig) -> tuple[int, callable]:
    """(n, predicate(t, s, i)) of one disfluency kind: does a trigger of n tokens begin at index i of
    the tokens t, where s(j) tells whether token j is a slot value?"""
    if kind == "hesitate":
        starts = [t.split()[0] for t in cfg.templates.get("hesitate", []) if t.split()]
        return 2, lambda t, s, i: in_set(t[i], starts) & ~in_set(t[i + 1], HESITATION_EXCLUDED_NEXT)
    if kind == "restart":
        return 3, lambda t, s, i: in_set(t[i], RESTART_FIRST) & in_set(t[i + 1], RESTART_SECOND)
    m = marker_lists(cfg, kind)
    if kind == "correct":
        return 3, lambda t, s, i: ((_marker_is([t[i]], m) & s(i + 1))
                                   | (_marker_is([t[i], t[i + 1]], m) & s(i + 2)))
    if kind == "correct_long_distance":
        return 3, lambda t, s, i: ((_marker_is([t[i]], m) & in_set(t[i + 1], PHRASE_LEFT_WORDS) & s(i + 2))
                                   | (_marker_is([t[i], t[i + 1]], m) & in_set(t[i + 2], PHRASE_LEFT_WORDS)))
    raise ValueError(kind)


KINDS = ["hesitate", "restart", "correct", "correct_long_distance"]


def _places(kinds: list[str], cfg: ActionConfig, t: Column) -> Column:
    """Indices of the bound token array t at which a trigger of one of the kinds may begin: few tokens, found by one look
    at each."""
    words = sorted({w for k in kinds for w in first_words(k, cfg)})
    found = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: in_set(t[i], words))
    return F.when(F.size(t) > 0, found).otherwise(F.array().cast("array<int>"))


def _may_begin(kinds: list[str], cfg: ActionConfig) -> Column:
    """Does the text hold the letters of a word that a trigger of one of the kinds begins with?  The texts without are
    told in generated code and not gone through by token."""
    words = sorted({w for k in kinds for w in first_words(k, cfg)})
    return F.col("text").rlike("|".join(map(re.escape, words))) if words else F.lit(False)


def _hits(kind: str, cfg: ActionConfig, vocab: SlotVocabulary, t: Column, places: Column) -> Column:
    """Those of the `places` at which a trigger of `kind` begins in the bound token array t."""
    n, pred = trigger_matches(kind, cfg)
    slot = (lambda j: vocab.is_slot(t[j])) if vocab.inlined else (lambda j: F.col("_slot")[j])
    return F.filter(places, lambda i: F.when(i <= F.size(t) - n, pred(t, slot, i)).otherwise(F.lit(False)))


def _with_tokens(turns: DataFrame, vocab: SlotVocabulary) -> tuple[DataFrame, Column]:
    """The turns and their tokens (an expression to bind, or a column beside `_slot`)."""
    if vocab.inlined:
        return turns, tokenize(F.trim("text"))
    return vocab.annotate(turns.withColumn("_toks", tokenize(F.trim("text"))), "_toks"), F.col("_toks")


def count_disfluencies(turns: DataFrame, cfg: ActionConfig, vocab: SlotVocabulary, kind: str,
                       by: list[str] | None = None) -> DataFrame:
    """E7a-d: triggers, user turns with at least one, distinct cases, share of user turns (null
    without user turns).

    One pass: `posexplode_outer` keeps one row per turn without hits, so every count comes
    from a single aggregation (one distinct aggregate: a two-phase plan, no Expand).
    """
    by = by or []
    n, _ = trigger_matches(kind, cfg)
    u, toks = _with_tokens(turns.where(F.col("agent") == "user"), vocab)
    cases = F.when(_may_begin([kind], cfg), let(toks, lambda t: F.transform(
        _hits(kind, cfg, vocab, t, _places([kind], cfg, t)), lambda i: F.array_join(F.slice(t, i + 1, n), " ")))).otherwise(
        F.array().cast("array<string>"))
    ex = u.select(*by, F.posexplode_outer(cases).alias("k", "h"))
    k = F.col("k")
    agg = ex.groupBy(*by).agg(
        F.count("h").alias("n_triggers"),
        F.count(F.when(k == 0, 1)).alias("n_turns"),
        F.countDistinct("h").alias("n_cases"),
        F.count(F.when(k.isNull() | (k == 0), 1)).alias("n_user_turns"),
    )
    return agg.select(*by, "n_triggers", "n_turns", "n_cases", "n_user_turns",
                      F.try_divide((F.col("n_turns") * 100).cast("double"), F.col("n_user_turns")).alias("pct_turns"))


def disfluency_report(corpora: DataFrame, cfg: ActionConfig, vocab: SlotVocabulary) -> DataFrame:
    """E7e: per corpus: #turns, #user turns and the four trigger counts (one pass).

    `corpus` may be a string or an array of corpus labels (a row counted in each): the trigger
    tests run once per row, the rows are summed per label set, and only the sums are exploded."""
    u, toks = _with_tokens(corpora, vocab)
    user = F.col("agent") == "user"
    # texts without the letters of a trigger's first word count nothing; the others are split in generated code
    u = u.withColumn("_told", F.when(user & _may_begin(KINDS, cfg), toks))
    counts = F.when(F.col("_told").isNotNull(), let(_places(KINDS, cfg, F.col("_told")), lambda at: F.struct(
        *[F.size(_hits(k, cfg, vocab, F.col("_told"), at)).alias(k) for k in KINDS])))
    x = u.select("corpus", user.alias("user"), F.inline_outer(F.array(counts)))
    sums = x.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("n_turns"), F.count(F.when(F.col("user"), 1)).alias("n_user_turns"),
        *[F.coalesce(F.sum(k), F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS],
        *[F.count(F.when(F.col(k) > 0, 1)).alias(f"turns_{k}") for k in KINDS])
    if not isinstance(corpora.schema["corpus"].dataType, ArrayType):
        return sums
    names = [c for c in sums.columns if c != "corpus"]
    return sums.select(F.explode("corpus").alias("corpus"), *names).groupBy("corpus").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in names])


def sliced_report(turns: DataFrame, multipliers: list[int], cfg: ActionConfig, vocab: SlotVocabulary, folder: str,
                  slice_copies: int = 10, seed: int = 273) -> DataFrame:
    """E7e for corpora of many copies (`k` copies of every dialogue for each k of `multipliers`), slice by slice.

    Draws are keyed by copy, so a corpus of k copies is copies 0 to k - 1 of the largest one.  Copies are
    augmented and counted `slice_copies` at a time; a slice leaves one row of sums per copy in
    `folder`, so the disk holds no augmented turns, and a run that was stopped goes on where the folder
    ends (the folder belongs to one corpus, configuration and seed).  Turns that are never rewritten
    are counted once and multiplied.
    """
    if cfg.can_fire("multiturn_correct"):
        raise ValueError("inserted turns change the other turns of a dialogue: use disfluency_report")
    spark = turns.sparkSession
    rewritten = (F.col("turn_idx") % 2 == 0) & ~is_silence(tokenize("text"))

    def kept(name: str, rows: Callable[[], DataFrame]) -> DataFrame:
        """The sums of a slice from the folder, or else from the rows: one file of few rows, there as a whole or not."""
        path = f"{folder.rstrip('/')}/{name}"
        try:
            found = spark.read.schema("corpus string, " + ", ".join(f"{c} long" for c in counters)).parquet(path)
            if not found.isEmpty():
                return found
        except AnalysisException:  # no such folder
            pass
        disfluency_report(rows(), cfg, vocab).select("corpus", *counters).coalesce(1).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    counters = ["n_turns", "n_user_turns", *[f"n_{k}" for k in KINDS], *[f"turns_{k}" for k in KINDS]]
    same = kept("others", lambda: turns.where(~F.coalesce(rewritten, F.lit(False))).select(F.lit("1").alias("corpus"), "agent", "text"))
    top, slices = max(multipliers), []
    some = turns.where(rewritten)
    for lo in range(0, top, slice_copies):
        hi = min(top, lo + slice_copies)
        copies = oversample(some, multiplier=hi - lo).withColumn("copy_no", (F.col("copy_no") + lo).cast("int"))
        slices.append(kept(f"copies-{lo}-{hi}", lambda c=copies: augment_turns(c, cfg, vocab, seed=seed).select(
            F.col("copy_no").cast("string").alias("corpus"), "agent", "text")))
    per_copy = reduce(lambda a, b: a.unionByName(b), slices)
    sizes = F.explode(F.filter(F.array(*[F.lit(k) for k in sorted(multipliers)]), lambda k: F.col("corpus").cast("int") < k))
    moved = per_copy.withColumn("k", sizes).groupBy("k").agg(*[F.sum(c).alias(c) for c in counters])
    fixed = same.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sorted(multipliers)]))).select("k", *[(F.col(c) * F.col("k")).alias(c) for c in counters])
    both = moved.unionByName(fixed).groupBy("k").agg(*[F.sum(c).cast("bigint").alias(c) for c in counters])
    return both.select(F.concat(F.col("k").cast("string"), F.lit("x")).alias("corpus"), *counters)


def _n_action(action: str) -> Column:
    return F.size(F.filter("actions", lambda p: p["action"] == F.lit(action)))


def augmentation_stats(aug: DataFrame, cfg: ActionConfig) -> DataFrame:
    """Dialogues modified, utterances modified and draws per action (NULL included)."""
    sel = aug.where(F.col("selected"))
    per_turn = sel.select("split", "dialogue_idx", "copy_no", "n_tokens", "actions",
                          ((F.size("actions") > 0) | (F.col("n_tokens") == 0)).alias("_mod"))
    acts = [a for a in cfg.actions if a != "NULL"]
    g = per_turn.agg(
        F.countDistinct(F.when(F.size("actions") > 0, F.struct("split", "dialogue_idx", "copy_no")))
        .alias("dialogues_modified"),
        F.count(F.when(F.col("_mod"), 1)).alias("utterances_modified"),
        (F.sum("n_tokens") - F.sum(F.size("actions"))).cast("bigint").alias("NULL"),
        *[F.sum(_n_action(a)).cast("bigint").alias(a) for a in acts],
    )
    metrics = ["dialogues_modified", "utterances_modified", "NULL", *acts]
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("bigint")
                                         .alias("value")) for m in metrics]))
    return g.select(stack.alias("s")).select("s.metric", F.coalesce("s.value", F.lit(0)).alias("value"))


def write_counted(aug: DataFrame, cfg: ActionConfig, path: str) -> DataFrame:
    """I1 with B7/E8: writes an augmented corpus as dialogue files and returns (metric, value), counted by the
    writing job itself.

    The turns and their counts are stored first: dealing them by ranges reads its input twice, which must not
    augment it twice.  The job groups turns into dialogues anyway; there each dialogue carries its sums, and
    observed metrics add them up while the files are written.
    """
    acts = [a for a in cfg.actions if a != "NULL"]
    own = F.col("selected") & (F.col("inserted_rank") == 0 if "inserted_rank" in aug.columns else F.lit(True))
    key = ["split", "dialogue_idx"] + (["copy_no"] if "copy_no" in aug.columns else [])

    def of_turn(value: Column, name: str) -> Column:
        return F.when(own, value).otherwise(0).alias(name)

    drawn = F.size("actions")
    counts = {"_drawn": drawn, "_NULL": F.col("n_tokens") - drawn, "_modified": ((drawn > 0) | (F.col("n_tokens") == 0)).cast("int"),
              **{f"_{a}": _n_action(a) for a in acts}}
    stored = scratch_path(aug.sparkSession, "counted-turns")
    turns = aug.select(*key, "turn_idx", "agent", "text", *[of_turn(v, n) for n, v in counts.items()])
    turns.write.parquet(stored)
    turns = aug.sparkSession.read.schema(turns.schema).parquet(stored)
    extra = [F.count(F.lit(1)).alias("_turns"), *[F.sum(f"`{n}`").cast("bigint").alias(n) for n in counts]]
    seen = Observation()

    def watch(dialogues: DataFrame) -> DataFrame:
        sums = [F.sum(f"`_{c}`").alias(c) for c in ("NULL", *acts)]
        return dialogues.observe(seen, F.count(F.when(F.col("_drawn") > 0, 1)).alias("dialogues_modified"),
                                 F.sum("_modified").alias("utterances_modified"), *sums, F.sum("_turns").alias("turns_written"))

    write_dialogue_text(turns, path, key, extra, watch)
    values = seen.get
    rows = [(m, int(values[m] or 0)) for m in ("dialogues_modified", "utterances_modified", "NULL", *acts, "turns_written")]
    return aug.sparkSession.createDataFrame(rows, "metric string, value bigint")


def limit_audit(aug: DataFrame, cfg: ActionConfig) -> DataFrame:
    """Per action, the largest per-utterance count and the configured limit (expect <=)."""
    sel = aug.where(F.col("selected"))
    acts = cfg.actions
    counts = [
        ((F.col("n_tokens") - F.size("actions")) if a == "NULL"
         else _n_action(a)).alias(a)
        for a in acts]
    per = sel.select(*counts)
    g = per.agg(*[F.max(F.col(f"`{a}`")).alias(a) for a in acts])
    stack = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.col(f"`{a}`").cast("bigint").alias("max_count"),
                                         F.lit(cfg.limit(a)).cast("bigint").alias("action_limit"))
                                for a in acts]))
    return g.select(stack.alias("s")).select("s.action", F.coalesce("s.max_count", F.lit(0)).alias("max_count"),
                                             "s.action_limit")
