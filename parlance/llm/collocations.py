"""Phrase collocation mining on count streams in prefix and suffix order (op12).

The layout of external n-gram estimation:

* **Counting.** Tasks turn slices of text into sorted runs of (words, language, count), orders one to
  three, and Spark adds the runs up.  Orders go upwards: an n-gram can only reach the least count
  if its two (n-1)-grams do, so the next order leaves out what cannot.  Which (n-1)-grams are
  frequent reaches the tasks as a sieve of a fixed greatest size (`SIEVE_BITS`): it may let
  infrequent ones pass, never the reverse, and exact counts decide; results do not depend on it.
* **Prefix stream.** All surviving counts in one range-partitioned sort by (lang, first word,
  second, third), short before long.  What a phrase begins with is then the last shorter row
  before it, so one lockstep pass gives every phrase the counts of its left parts; no lookup
  table is made.  The two rows that are open at the end of a partition travel to the next one
  (one row per partition).  A hot first word spreads over as many partitions as its phrases need.
* **Suffix stream.** The same rows in the order of their last word, the one before, and so on,
  give the counts of the right parts in the same way.
* **Extensions.** A three-word phrase meets both its two-word parts in the two streams; where it
  is frequent enough against one, it names it as covered (at most four names a phrase), and a
  sort-merge anti-join removes the covered phrases.

Scores are integers from decimals of 38 digits.  The first phrases of a language are ranked within
hashed shares first, so that a language with most of the rows is not sorted by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import U64, mix, read_table, stored, text_slices, word_hashes, words
from parlance.session import ensure_checkpoint_dir

MIN_COUNT, COVER_PERCENT, TOP = 10, 50, 2000
#: The sieve takes 16 bits for each frequent n-gram and 2^28 bits (32 MB) at most.
SIEVE_BITS = 28
SLICE_BYTES = 2 << 20
SHARES = 32

#: What ends a piece; A-Z become a-z; tab and space part words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9] = 32
FOLD[list(BREAKS)] = 10


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    off = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=off[1:])
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(data)])


def _hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every task."""
    out = np.zeros(len(values), U64)
    for row, data, off in text_slices(values, SLICE_BYTES):
        out[row:row + len(off) - 1] = word_hashes(data, off[:-1], off[1:])
    return out


def _word_key(lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(word + mix(lang) * U64(3))


def _pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * U64(5) + second)


class Sieve:
    """A bitmap that holds the keys of the frequent (n-1)-grams."""

    def __init__(self, bits: int, bitmap: bytes):
        self.bits, self.bitmap = bits, bitmap

    def passes(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> U64(64 - self.bits)).astype(np.int64)
        return (np.frombuffer(self.bitmap, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def build_sieve(grams: DataFrame, order: int) -> Sieve:
    """The sieve of a table (lang, w1[, w2]); at most 2^SIEVE_BITS bits reach the driver."""
    bits = int(np.clip(np.ceil(np.log2(16.0 * max(grams.count(), 1))), 16, SIEVE_BITS))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = _hashes(b.column(0))
            key = _word_key(lang, _hashes(b.column(1)))
            if order == 2:
                key = _pair_key(key, _word_key(lang, _hashes(b.column(2))))
            yield pa.RecordBatch.from_arrays([pa.array((key >> U64(64 - bits)).astype(np.int64))], ["at"])

    at = grams.select("lang", "w1", *(["w2"] if order == 2 else [])).mapInArrow(places, "at long")
    maps = at.groupBy(F.shiftright("at", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias("bits"))
    bitmap = bytearray(1 << (bits - 3))
    for r in maps.toLocalIterator():
        bitmap[r.bucket << 12:(r.bucket + 1) << 12] = r.bits
    return Sieve(bits, bytes(bitmap))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True, return_counts=True)


def count_slice(data: np.ndarray, off: np.ndarray, lang: np.ndarray, n_langs: int, lang_hash: np.ndarray, order: int,
                sieve: Sieve | None) -> tuple[pa.Array, list[np.ndarray], np.ndarray, np.ndarray]:
    """(words in byte order, columns of word numbers, lang numbers, counts) of a slice's n-grams of one order."""
    data = FOLD[data]
    starts, ends, first = words(data, off)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return pa.array([], pa.string()), [none] * order, none, none
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    coded = _strings(data[(data != 32) & (data != 10)], ends - starts).dictionary_encode()
    by_byte = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(by_byte), np.int64)
    rank[by_byte] = np.arange(len(by_byte))
    vocab = coded.dictionary.take(pa.array(by_byte))
    one, at, n = _distinct(rank[coded.indices.to_numpy()] * n_langs + lang[row])
    if order == 1:
        return vocab, [one // n_langs], one % n_langs, n
    key = _word_key(lang_hash[one % n_langs], _hashes(vocab)[one // n_langs])
    breaks = np.cumsum(data == 10)
    joined = (breaks[starts[1:] - 1] == breaks[ends[:-1] - 1]) & (row[1:] == row[:-1])
    if order == 2:
        ok = sieve.passes(key)[at]
        joined &= ok[1:] & ok[:-1]
    left = np.flatnonzero(joined)
    two, at2, n2 = _distinct(at[left] * len(one) + at[left + 1])
    a, b = two // max(len(one), 1), two % max(len(one), 1)
    if order == 2:
        return vocab, [one[a] // n_langs, one[b] // n_langs], one[a] % n_langs, n2
    ok = sieve.passes(_pair_key(key[a], key[b]))[at2]
    pair = np.full(len(at), -1)
    pair[left[ok]] = at2[ok]
    left = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
    three, _, n3 = _distinct(pair[left] * len(two) + pair[left + 1])
    p, q = (three // max(len(two), 1), three % max(len(two), 1))
    return vocab, [one[a[p]] // n_langs, one[b[p]] // n_langs, one[b[q]] // n_langs], one[a[p]] % n_langs, n3


def count_grams(texts: DataFrame, order: int, sieve: Sieve | None) -> DataFrame:
    """(gram, n) over all rows of (lang, text).  A gram is one string, so that adding up moves one key column: its
    words joined by a space, a tab, the language (words hold neither space nor tab)."""
    shared = texts.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = b.column(0).dictionary_encode()
            langs, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            lang_hash, tails = _hashes(langs), pc.binary_join_element_wise("", langs, "\t")
            for r, data, off in text_slices(b.column(1), SLICE_BYTES):
                vocab, cols, lang, n = count_slice(data, off, code[r:r + len(off) - 1], len(langs), lang_hash, order, shared.value)
                phrase = pc.binary_join_element_wise(*(vocab.take(pa.array(c)) for c in cols), " ") if order > 1 else vocab.take(pa.array(cols[0]))
                yield pa.RecordBatch.from_arrays(
                    [pc.binary_join_element_wise(phrase, tails.take(pa.array(lang)), ""), pa.array(n, pa.int64())], ["gram", "n"])

    return texts.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def columns_of(grams: DataFrame, order: int) -> DataFrame:
    """(lang, w1..w_order, n) of (gram, n)."""
    parts = F.split("gram", "\t", 2)
    found = grams.select(parts[1].alias("lang"), F.split(parts[0], " ").alias("w"), "n")
    return found.select("lang", *(F.col("w")[k].alias(f"w{k + 1}") for k in range(order)), "n")


def _lockstep(rows: DataFrame, keys: list[str], one: str, two: str) -> DataFrame:
    """Adds the counts of the one-word (`one`) and two-word (`two`) rows that each row begins with in the order of
    `keys` (the words in that order, null beyond a row's size).  Every such row must be there."""
    ensure_checkpoint_dir(rows.sparkSession)
    order = ["lang", *keys]
    stream = rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint(eager=True) \
        .withColumn("_part", F.spark_partition_id())
    ends = stream.groupBy("_part").agg(
        F.expr(f"max_by(n, struct(lang, {keys[0]})) filter (where size = 1)").alias("e1"),
        F.expr(f"max_by(n, struct(lang, {keys[0]}, {keys[1]})) filter (where size = 2)").alias("e2"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_part", F.last("e1", True).over(before).alias("_c1"), F.last("e2", True).over(before).alias("_c2"))
    fed = stream.join(F.broadcast(ends), "_part").drop("_part")  # one row per partition of the stream
    schema = pa.schema([("_", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list[int] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            if state is None:
                state = [b.column(b.schema.get_field_index(c))[0].as_py() or 0 for c in ("_c1", "_c2")]
            size, n = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("size", "n"))
            cols = []
            for k in (0, 1):
                last = np.maximum.accumulate(np.where(size == k + 1, np.arange(len(size)), -1))
                got = np.where(last >= 0, n[last], state[k])
                state[k] = int(got[-1])
                cols.append(pa.array(got, pa.int64()))
            keep = [i for i, f in enumerate(b.schema) if f.name not in ("_c1", "_c2")]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *cols], [*(b.schema[i].name for i in keep), one, two])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in fed.schema if f.name not in ("_c1", "_c2")]
    return fed.mapInArrow(run, ", ".join([*kept, f"{one} long", f"{two} long"]))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 cover_percent: int = COVER_PERCENT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of two or three words of each language.

    A null text is empty, a null language `und`; repeated rows count each time; other columns are
    not read.  Ties of the score are settled by a, then by the phrase's bytes.  A language without
    candidates, and an empty table, give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    enough = F.col("n") >= min_count
    ones = stored(spark, columns_of(count_grams(texts, 1, None), 1), "counts-1")
    totals = ones.groupBy("lang").agg(F.sum("n").alias("total"))
    ones = ones.where(enough)
    twos = stored(spark, columns_of(count_grams(texts, 2, build_sieve(ones, 1)).where(enough), 2), "counts-2")
    threes = stored(spark, columns_of(count_grams(texts, 3, build_sieve(twos, 2)).where(enough), 3), "counts-3")
    none = F.lit(None).cast("string")
    rows = ones.select("lang", F.lit(1).alias("size"), "w1", none.alias("w2"), none.alias("w3"), "n").unionByName(
        twos.select("lang", F.lit(2).alias("size"), "w1", "w2", none.alias("w3"), "n")).unionByName(
        threes.select("lang", F.lit(3).alias("size"), "w1", "w2", "w3", "n"))
    lefts = _lockstep(rows, ["w1", "w2", "w3"], "l1", "l2")
    ends = [F.when(F.col("size") == 1, F.col("w1")).when(F.col("size") == 2, F.col("w2")).otherwise(F.col("w3")),
            F.when(F.col("size") == 2, F.col("w1")).when(F.col("size") == 3, F.col("w2")),
            F.when(F.col("size") == 3, F.col("w1"))]
    both = _lockstep(lefts.select("*", *(e.alias(f"v{k + 1}") for k, e in enumerate(ends))), ["v1", "v2", "v3"], "r1", "r2")
    both = stored(spark, both.where("size > 1").drop("v1", "v2", "v3"), "phrases")

    long = both.where("size = 3")
    covered = long.where(F.col("n") * 100 >= F.col("l2") * cover_percent).select("lang", "w1", "w2").unionByName(
        long.where(F.col("n") * 100 >= F.col("r2") * cover_percent).select(
            "lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"))).distinct()
    short = both.where("size = 2").join(covered.hint("merge"), ["lang", "w1", "w2"], "left_anti")

    def score(left: str, right: str):
        return F.expr(f"(1000000 * cast(n as decimal(19, 0)) * cast(n as decimal(19, 0)))"
                      f" div (cast({left} as decimal(19, 0)) * cast({right} as decimal(19, 0)))")

    cut = F.struct(score("l1", "r2").alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("r2").alias("r"))
    cut2 = F.struct(score("l2", "r1").alias("score"), F.lit(2).alias("k"), F.col("l2").alias("l"), F.col("r1").alias("r"))
    scored = short.withColumn("cut", F.struct(score("l1", "r1").alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"),
                                              F.col("r1").alias("r"))).select("lang", "w1", "w2", "w3", "n", "cut") \
        .unionByName(long.withColumn("cut", F.least(cut, cut2)).select("lang", "w1", "w2", "w3", "n", "cut")) \
        .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), "cut.score", "cut.l", "cut.r") \
        .withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = scored.withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))) \
        .where(F.col("place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    gram = "SELECT lang, {cols}, count(*) AS n FROM g WHERE w{k} IS NOT NULL GROUP BY ALL"
    f1, f2, f3 = (gram.format(cols=", ".join(f"w{j + 1}" for j in range(k)), k=k) for k in (1, 2, 3))
    score = "CAST(1000000::HUGEINT * {a}.n * {a}.n // ({l}.n::HUGEINT * {r}.n) AS BIGINT)"
    return f"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece
  FROM documents),
lists AS (SELECT lang, row_number() OVER () AS p, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
flat AS (SELECT lang, p, unnest(w) AS w1, unnest(range(1, len(w) + 1)) AS i FROM lists),
g AS MATERIALIZED (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM flat WINDOW o AS (PARTITION BY p ORDER BY i)),
f1 AS MATERIALIZED ({f1}), f2 AS MATERIALIZED ({f2}), f3 AS MATERIALIZED ({f3}),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f1 GROUP BY lang),
two AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.n AS a, x.n AS l, y.n AS r, {score.format(a='f2', l='x', r='y')} AS score
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  WHERE f2.n >= {MIN_COUNT}
    AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = f2.lang AND t.w1 = f2.w1 AND t.w2 = f2.w2 AND t.n >= {MIN_COUNT} AND 100 * t.n >= {COVER_PERCENT} * f2.n)
    AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = f2.lang AND t.w2 = f2.w1 AND t.w3 = f2.w2 AND t.n >= {MIN_COUNT} AND 100 * t.n >= {COVER_PERCENT} * f2.n)),
cuts AS (SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.n AS a,
         x.n AS l1, yz.n AS r2, xy.n AS l2, z.n AS r1,
         {score.format(a='f3', l='x', r='yz')} AS s1, {score.format(a='f3', l='xy', r='z')} AS s2
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f1 z ON z.lang = f3.lang AND z.w1 = f3.w3
  JOIN f2 xy ON xy.lang = f3.lang AND xy.w1 = f3.w1 AND xy.w2 = f3.w2
  JOIN f2 yz ON yz.lang = f3.lang AND yz.w1 = f3.w2 AND yz.w2 = f3.w3
  WHERE f3.n >= {MIN_COUNT}),
scored AS (SELECT * FROM two UNION ALL
  SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
SELECT lang, rank, phrase, a, l, r, totals.n AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}"""
