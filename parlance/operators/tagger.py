"""Disfluency tagger (F5): a finite-state labeller of reparandum / interregnum / repair.

States FLUENT, INTERREGNUM, REPARANDUM, REPAIR; buffers of tokens; prefix matching against
the edit-term markers of the action templates and against delexicalised slot phrases.
The whole machine is one `aggregate` over the (delexicalised) tokens of an utterance.  Buffers are
space-joined strings (tokens hold no spaces).  "Is a prefix of some marker" is a hash-set lookup
among the prefixes of the configuration's markers.  The phrases of a corpus may be any number: their
prefixes are a stored table.  A buffer is always a piece of its utterance, and a phrase consists of
the phrase rule's extension words and `<value>`; a join with the table tells how far the longest prefix
reaches at each token, and the fold compares a buffer's length with that.
Each *distinct* delexicalised utterance is tagged once; nothing goes through the driver.

Outputs `<f/>` (fluent), `<e/>` (edit term), `<rm-N/><rpEndSub/>`, `<rm-N/><rpMid/>`, `<rpEnd/>`.
When the machine loses a token (two slot values in a row after a marker) the tag array is
shorter than the utterance: the result is then NULL and `tag_length_mismatch` is true.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PHRASE_LEFT_WORDS, PHRASE_RIGHT_WORDS, in_set, let, tokenize
from ..session import scratch_path
from ..sources.config import ActionConfig
from .vocab import VALUE, SlotVocabulary, delexicalized, slot_phrases

FLUENT, INTERREGNUM, REPARANDUM, REPAIR = 0, 1, 2, 3
_SA = "array<string>"


def markers(cfg: ActionConfig) -> list[list[str]]:
    """Template words of every non-NULL action (operands `$…` removed)."""
    out = []
    for action, templates in cfg.templates.items():
        if action == "NULL":
            continue
        out += [[t for t in tmpl.split() if not t.startswith("$")] for tmpl in templates]
    return out


#: The words a delexicalised slot phrase may consist of.
PHRASE_WORDS = [*PHRASE_LEFT_WORDS, VALUE, *PHRASE_RIGHT_WORDS]


def _stored(df: DataFrame, tag: str) -> DataFrame:
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def phrase_prefixes(turns: DataFrame, vocab: SlotVocabulary) -> DataFrame:
    """The table (prefix, n_words) of all prefixes of the delexicalised slot phrases (E3) of a corpus, stored."""
    words = F.split("phrase", " ")
    prefixes = slot_phrases(turns, vocab, delexicalize=True).select(F.explode(F.transform(
        F.sequence(F.lit(1), F.size(words)), lambda k: F.struct(F.array_join(F.slice(words, 1, k), " ").alias("prefix"),
                                                                k.alias("n_words")))).alias("p"))
    return _stored(prefixes.select("p.prefix", "p.n_words").distinct(), "phrase-prefixes")


def phrase_reach(utterances: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(utterance, reach): for each token of a distinct delexicalised utterance, how many words of some phrase it and
    the tokens after it begin with (0: none); stored.

    All prefixes of a prefix are in the table, so the longest one at a token is found by bisection: each
    round joins one piece per token that can begin a phrase (an extension word to the left, or a
    value) with the table.  The number of rounds is the logarithm of the longest phrase.  Both sides
    of the join are plain rows, so a piece that most utterances hold is split by AQE.
    """
    longest = prefixes.agg(F.max("n_words")).first()[0] or 0
    toks = F.filter(F.split("utterance", " "), lambda x: x != "")
    at = F.posexplode(let(toks, lambda t: F.transform(t, lambda w, i: F.when(
        in_set(w, PHRASE_WORDS[:len(PHRASE_LEFT_WORDS) + 1]), _phrase_words(F.slice(t, i + 1, longest))))))
    open_ = utterances.select("utterance", at.alias("i", "rest")).where(F.size("rest") > 0) \
        .select("utterance", "i", "rest", F.lit(0).alias("lo"), F.size("rest").alias("hi"))
    table = prefixes.select("prefix", F.lit(True).alias("is_prefix"))
    for _ in range(longest.bit_length()):
        mid = ((F.col("lo") + F.col("hi") + 1) / 2).cast("int")
        asked = open_.withColumn("mid", mid).withColumn("prefix", F.array_join(F.slice("rest", 1, mid), " "))
        told = asked.join(table, "prefix", "left")
        hit = F.col("is_prefix").isNotNull()
        open_ = told.select("utterance", "i", "rest", F.when(hit, F.col("mid")).otherwise(F.col("lo")).alias("lo"),
                            F.when(hit, F.col("hi")).otherwise(F.greatest(F.col("mid") - 1, F.col("lo"))).alias("hi"))
    found = open_.where("lo > 0").groupBy("utterance").agg(F.collect_list(F.struct("i", "lo")).alias("found"))
    reach = let(F.map_from_entries("found"), lambda m: F.transform(toks, lambda w, i: F.coalesce(F.try_element_at(m, i), F.lit(0))))
    return _stored(found.select("utterance", reach.alias("reach")), "phrase-reach")


def _phrase_words(rest: Column) -> Column:
    """The leading run of phrase words."""
    def cut(r: Column) -> Column:
        miss = F.array_position(F.transform(r, lambda w: in_set(w, PHRASE_WORDS)), False)
        return F.when(miss == 0, r).otherwise(F.slice(r, 1, (miss - 1).cast("int")))

    return let(rest, cut)


def _prefixes(lists) -> list[str]:
    return sorted({" ".join(l[:k]) for l in lists for k in range(1, len(l) + 1)})


def _among(buf: Column, strings: list[str]) -> Column:
    return buf.isin(strings) if strings else F.lit(False)


def _prefix_of(buf: Column, target: Column) -> Column:
    return (buf == target) | target.startswith(F.concat(buf, F.lit(" ")))


def _rep(tag: str, n: Column) -> Column:
    return F.array_repeat(F.lit(tag), F.greatest(n, F.lit(0)).cast("int"))


def tag_tokens(tokens: Column, marker_lists: list[list[str]], reach: Column) -> Column:
    """Fold the tagger over a token array (already delexicalised); returns the tag array.  `reach` tells for each token
    how many words of some phrase begin there (`phrase_reach`)."""
    marker_prefixes = _prefixes(marker_lists)
    whole_markers = sorted({" ".join(m) for m in marker_lists if m})
    m_any = lambda buf: _among(buf, marker_prefixes)
    # the reparandum buffer is the last `nrep` tokens before the current one
    p_one = lambda x: reach[x["i"]] >= 1
    p_grown = lambda st, x: reach[x["i"] - st["nrep"]] > st["nrep"]
    empty = F.lit("")

    def plus(buf, t):
        return F.when(buf == "", t).otherwise(F.concat_ws(" ", buf, t))

    def size(buf):
        return F.when(buf == "", 0).otherwise(F.size(F.split(buf, " ")))

    def mk(st, s=None, fl=None, rep=None, itg=None, rpr=None, tags=None, nrep=None):
        return F.struct(
            (nrep if nrep is not None else st["nrep"]).alias("nrep"),
            (F.lit(s) if isinstance(s, int) else (s if s is not None else st["s"])).alias("s"),
            (fl if fl is not None else st["fl"]).alias("fl"),
            (rep if rep is not None else st["rep"]).alias("rep"),
            (itg if itg is not None else st["itg"]).alias("itg"),
            (rpr if rpr is not None else st["rpr"]).alias("rpr"),
            (tags if tags is not None else st["tags"]).alias("tags"))

    def flushed(st):
        return let(F.struct(size(st["itg"]).alias("ni"), size(st["rpr"]).alias("nr")), lambda n: _flushed(st, n))

    def _flushed(st, n):
        ni, nr = n["ni"], n["nr"]
        itg_tags = F.when(_among(st["itg"], whole_markers), _rep("<e/>", ni)).otherwise(_rep("<f/>", ni))
        rpr_tags = (F.when(nr == 1, F.array(F.format_string("<rm-%d/><rpEndSub/>", ni + 1)))
                    .when(nr > 1, F.concat(F.array(F.format_string("<rm-%d/><rpMid/>", ni + 1)),
                                           _rep("<f/>", nr - 2), F.array(F.lit("<rpEnd/>"))))
                    .otherwise(F.array().cast(_SA)))
        return F.concat(st["tags"], _rep("<f/>", st["fl"]), itg_tags, rpr_tags)

    def step(st, x):
        t = x["t"]
        itg_t, rep_t, rpr_t = plus(st["itg"], t), plus(st["rep"], t), plus(st["rpr"], t)
        fl1, grown = st["fl"] + 1, dict(rep=rep_t, nrep=st["nrep"] + 1)
        fluent = (F.when(m_any(t), mk(st, s=INTERREGNUM, itg=itg_t))
                  .when(p_grown(st, x), mk(st, s=REPARANDUM, fl=fl1, **grown))
                  .otherwise(mk(st, fl=fl1)))
        nothing = dict(rep=empty, nrep=F.lit(0), rpr=empty)
        again = dict(tags=flushed(st), fl=F.lit(1), rep=t, nrep=F.lit(1), itg=empty, rpr=empty)
        reset = dict(s=FLUENT, tags=flushed(st), fl=F.lit(1), itg=empty, **nothing)
        interregnum = (F.when(m_any(itg_t), mk(st, itg=itg_t))
                       .when(_prefix_of(rpr_t, st["rep"]), mk(st, s=REPAIR, rpr=rpr_t))
                       .when(t == VALUE, mk(st, rpr=t))
                       .otherwise(mk(st, **reset)))
        reparandum = (F.when(p_grown(st, x), mk(st, fl=fl1, **grown))
                      .when(m_any(itg_t), mk(st, s=INTERREGNUM, itg=itg_t))
                      .when(p_one(x), mk(st, s=REPARANDUM, **again))
                      .otherwise(mk(st, **reset)))
        repair = (F.when(_prefix_of(rpr_t, st["rep"]), mk(st, rpr=rpr_t))
                  .when(m_any(t), mk(st, s=INTERREGNUM, tags=flushed(st), fl=F.lit(0), itg=t, **nothing))
                  .when(p_one(x), mk(st, s=REPARANDUM, **again))
                  .otherwise(mk(st, **reset)))
        return (F.when(st["s"] == FLUENT, fluent).when(st["s"] == INTERREGNUM, interregnum)
                .when(st["s"] == REPARANDUM, reparandum).otherwise(repair))

    zero = F.struct(F.lit(0).alias("nrep"), F.lit(FLUENT).alias("s"), F.lit(0).alias("fl"), empty.alias("rep"),
                    empty.alias("itg"), empty.alias("rpr"), F.array().cast(_SA).alias("tags"))
    numbered = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    return F.aggregate(numbered, zero, step, lambda st: flushed(st))


def tag_utterances(df: DataFrame, text_col: str, cfg: ActionConfig, vocab: SlotVocabulary, prefixes: DataFrame) -> DataFrame:
    """Adds `tags` (NULL on a length mismatch) and `tag_length_mismatch` for `text_col`.

    The input is stored once, since both the distinct utterances and the join back read it; the tagged
    utterances are stored, so that the join back can split an utterance that is most of all rows.
    """
    marked = vocab.annotate(df.withColumn("_toks", tokenize(text_col)), "_toks")
    rows = _stored(marked.withColumn("_delex", F.array_join(delexicalized("_toks"), " ")).drop("_toks", "_slot"), "to-tag")
    distinct = _stored(rows.select(F.col("_delex").alias("utterance")).distinct(), "utterances")
    toks = F.filter(F.split("utterance", " "), lambda x: x != "")
    found = distinct.join(phrase_reach(distinct, prefixes), "utterance", "left").withColumn(
        "reach", F.coalesce("reach", F.array_repeat(F.lit(0), F.size(toks))))
    res = let(toks, lambda t: let(tag_tokens(t, markers(cfg), F.col("reach")), lambda tg: F.struct(
        F.when(F.size(tg) == F.size(t), tg).alias("tags"), (F.size(tg) != F.size(t)).alias("tag_length_mismatch"))))
    tagged = _stored(found.select("utterance", F.inline_outer(F.array(res))), "tagged-utterances")
    return rows.join(tagged, F.col("_delex") == F.col("utterance")).drop("_delex", "utterance")
