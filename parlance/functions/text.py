"""Column expressions over utterance text and token arrays.

Everything here is a built-in Spark expression (higher-order functions over arrays),
so it runs inside the JVM with no Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word sets of the enclosing-phrase rule (left extension, right extension).
PHRASE_LEFT_WORDS = ["with", "for", "in", "a"]
PHRASE_RIGHT_WORDS = ["cuisine", "food", "people", "price", "range"]

# The silence marker of user turns.
SILENCE = "<SILENCE>"

# Closed-class lexicon standing in for the part-of-speech tagger. Only the
# tags IN (preposition / subordinating conjunction) and DT (determiner) are ever read.
PREPOSITIONS = [
    "about", "above", "across", "after", "against", "along", "among", "around", "as", "at",
    "before", "behind", "below", "beneath", "beside", "between", "beyond", "by", "despite",
    "during", "except", "for", "from", "in", "inside", "into", "like", "near", "of", "off",
    "on", "onto", "out", "outside", "over", "per", "since", "than", "through", "throughout",
    "till", "toward", "towards", "under", "until", "upon", "via", "with", "within", "without",
    "because", "if", "whether", "while", "although", "though", "unless",
]
DETERMINERS = [
    "a", "an", "the", "this", "that", "these", "those", "some", "any", "each", "every", "no",
    "another", "all", "both", "either", "neither",
]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize(text: Column | str) -> Column:
    """Whitespace split with no empty tokens; unicode-aware (U+00A0 and U+3000 split too).

    Texts of printable ASCII words with one space between them, the common case, are split at the spaces; the
    regular expression is for all others."""
    t = _c(text)
    plain = ~t.rlike("[^ -~]") & ~F.contains(t, F.lit("  ")) & ~t.startswith(" ") & ~t.endswith(" ") & (t != F.lit(""))
    return F.when(plain, F.split(t, " ")).otherwise(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != F.lit("")))


def let(value: Column, fn) -> Column:
    """Bind `value` once and use it several times in `fn` (it is evaluated once a row).

    The start value of a fold over nothing: unlike an element of a `transform`, it and the result are not copied."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, x: acc, fn)


def clean_text(text: Column | str, replacements: Sequence[tuple[str, str]]) -> Column:
    """Ordered literal replacements (a fold of `replace`)."""
    out = _c(text)
    for pattern, replacement in replacements:
        out = F.replace(out, F.lit(pattern), F.lit(replacement))
    return out


def is_api_call(text: Column | str) -> Column:
    """Prefix test, as in the reference: `api_callX` matches too."""
    return _c(text).startswith("api_call")


def is_silence(tokens: Column | str) -> Column:
    return (F.size(_c(tokens)) == 1) & (F.element_at(_c(tokens), 1) == F.lit(SILENCE))


def in_set(x: Column, words: Iterable[str]) -> Column:
    """Membership in a literal word set; Catalyst turns long lists into a hash set (InSet)."""
    words = list(words)
    if not words:
        return F.lit(False)
    return x.isin(words)


def ngrams(tokens: Column | str, n: int) -> Column:
    """Adjacent n-grams of one token array as an array of arrays (empty when shorter than n)."""
    def grams(t: Column) -> Column:
        g = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array(*[t[i + k] for k in range(n)]))
        return F.when(F.size(t) >= n, g).otherwise(F.array().cast("array<array<string>>"))

    return let(_c(tokens), grams)


def phrase_bounds(tokens: Column | str, idx: Column,
                  left_words: Sequence[str] = PHRASE_LEFT_WORDS,
                  right_words: Sequence[str] = PHRASE_RIGHT_WORDS) -> Column:
    """Struct(begin, end) of the phrase enclosing token `idx` (0-based, inclusive bounds).

    Extends left while the preceding token is in `left_words`, right while the following
    token is in `right_words`.
    """
    t = _c(tokens)
    left = F.reverse(_slice0(t, F.lit(0), idx))
    right = _slice0(t, idx + 1, F.size(t) - idx - 1)
    n_left = _short_run(lambda k: F.get(t, idx - k), left_words, let(left, lambda a: _leading_run(a, left_words)))
    n_right = _short_run(lambda k: F.get(t, idx + k), right_words, let(right, lambda a: _leading_run(a, right_words)))
    return F.struct((idx - n_left).alias("begin"), (idx + n_right).alias("end"))


def _short_run(at, words: Sequence[str], whole: Column) -> Column:
    """Length of the run of tokens at(1), at(2), ... in `words`; only a run of three or more is looked at as a `whole`."""
    ends = [~F.coalesce(in_set(at(k), words), F.lit(False)) for k in (1, 2, 3)]
    return F.when(ends[0], F.lit(0)).when(ends[1], F.lit(1)).when(ends[2], F.lit(2)).otherwise(whole)


def _slice0(arr: Column, start0: Column, length: Column) -> Column:
    """slice with a 0-based start that tolerates empty ranges."""
    return F.when(length > 0, F.slice(arr, start0 + 1, length)).otherwise(
        F.array().cast("array<string>"))


def _leading_run(arr: Column, words: Sequence[str]) -> Column:
    """Length of the leading run of `arr` whose items are in `words`."""
    first_miss = F.array_position(F.transform(arr, lambda x: in_set(x, words)), False)
    return let(first_miss, lambda m: F.when(m == 0, F.size(arr)).otherwise(m - 1).cast("int"))


def enclosing_phrase(tokens: Column | str, idx: Column, **kw) -> Column:
    """Tokens of the phrase enclosing token `idx`."""
    t = _c(tokens)
    b = phrase_bounds(t, idx, **kw)
    return F.slice(t, b["begin"] + 1, b["end"] - b["begin"] + 1)


def closed_class_pos(tokens: Column | str) -> Column:
    """Per-token tag: IN, DT or X (other), from the fixed closed-class lexicon."""
    return F.transform(
        _c(tokens),
        lambda t: F.when(in_set(t, PREPOSITIONS), "IN").when(in_set(t, DETERMINERS), "DT")
        .otherwise("X"),
    )


def render_tagged(tokens: Column | str, tags: Column | str) -> Column:
    """`token|tag` pairs joined by spaces, truncated to the shorter array."""
    t, g = _c(tokens), _c(tags)
    n = F.least(F.size(t), F.size(g))
    return F.array_join(
        F.zip_with(_slice0(t, F.lit(0), n), _slice0(g, F.lit(0), n),
                   lambda a, b: F.concat_ws("|", a, b)),
        " ",
    )
