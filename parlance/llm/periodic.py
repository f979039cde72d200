"""Periodic run detection by recursive frequency splitting (op13).

A run is a maximal stretch of words with smallest period q and a length of at least max(6, 4 q).
Every word of a run occurs in it at least four times, so

1. words that occur fewer than four times in a segment split it; the parts are counted again and
   split again until nothing changes; parts of fewer than six words are dropped;
2. the surviving segments are scanned lag by lag.  A run of period q matches at lag q on at least
   s = max(6, 4 q) - q neighbouring words, so it covers three neighbouring multiples of s // 3: only
   those are compared, about m ln m comparisons for a segment of m words, and only where
   three in a row agree the stretch is measured.  Lags go upwards; a stretch that a run of a
   smaller period (a divisor of the lag) fills is that run again.

One document is one row and is read whole; nothing is shuffled, and a lost task is run again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import read_table, small

#: Fixed values of the definition: a run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Comparisons prepared at once (bounds a scan's memory whatever the segment's length).
PROBES = 1 << 18

Run = tuple[int, int, int]  # start, length, period


def word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """The stretches [a, b) that hold every run: within each, every word occurs at least TIMES times."""
    done, open_ = [], [(0, len(ids))]
    while open_:
        a, b = open_.pop()
        if b - a < LEAST:
            continue
        part = np.unique(ids[a:b], return_inverse=True)[1]
        rare = np.flatnonzero(np.bincount(part)[part] < TIMES)
        if not len(rare):
            done.append((a, b))
            continue
        edges = np.concatenate(([-1], rare, [b - a]))
        long = np.flatnonzero(np.diff(edges) > LEAST)
        open_.extend((a + int(edges[i]) + 1, a + int(edges[i + 1])) for i in long)
    return sorted(done)


def _reach(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning, compared in growing pieces."""
    at, step, n = 0, 64, len(x)
    while at < n:
        differ = np.flatnonzero(x[at:at + step] != y[at:at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def _stretch(w: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The maximal [a, b) around i, i + q whose words have period q."""
    m = len(w)
    b = i + q + _reach(w[i:m - q], w[i + q:m])
    a = i - _reach(w[:i][::-1], w[q:i + q][::-1])
    return a, b


def _suspects(w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(lag, positions to measure from) in rising order of the lag."""
    m, q = len(w), 1
    while q * TIMES <= m:
        lags, total = [], 0
        while q * TIMES <= m and (not lags or total < PROBES):
            lags.append(q)
            total += m // max(1, (max(LEAST, TIMES * q) - q) // 3) + 1
            q += 1
        lag = np.array(lags)
        step = np.maximum(1, (np.maximum(LEAST, TIMES * lag) - lag) // 3)
        count = np.maximum(0, (m - lag - 1) // step + 1)
        first = np.cumsum(count) - count
        row = np.repeat(np.arange(len(lag)), count)
        at = (np.arange(int(count.sum())) - first[row]) * step[row]
        same = w[at] == w[at + lag[row]]
        three = same[:-2] & same[1:-1] & same[2:] & (row[:-2] == row[2:])
        hit = np.flatnonzero(three)
        for k in np.split(hit, np.flatnonzero(np.diff(row[hit])) + 1) if len(hit) else []:
            yield int(lag[row[k[0]]]), at[k]


def runs_in(w: np.ndarray) -> list[Run]:
    """All runs of one segment."""
    found: list[Run] = []
    for q, places in _suspects(w):
        smaller = np.array([(s, s + n) for s, n, p in found if q % p == 0], np.int64).reshape(-1, 2)
        if len(smaller):  # positions i with i and i + q inside a run of a divisor of q lead to that run again
            smaller = smaller[np.argsort(smaller[:, 0], kind="stable")]
            reach = np.concatenate(([-1], np.maximum.accumulate(smaller[:, 1])))
            places = places[reach[np.searchsorted(smaller[:, 0], places, "right")] <= places + q]
        end = -1
        for i in places.tolist():
            if i + q < end:
                continue  # inside the stretch that was measured last
            a, end = _stretch(w, i, q)
            if end - a >= max(LEAST, TIMES * q):
                found.append((a, end - a, q))
    return found


def runs(ids: np.ndarray) -> list[Run]:
    """Every run of a document as (start, length, period), by start, then period."""
    found = [(a + s, n, q) for a, b in segments(ids) for s, n, q in runs_in(ids[a:b])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, found: list[Run]) -> np.ndarray:
    """True for words that no run contains after its first period."""
    cover = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        cover[start + period] += 1
        cover[start + length] -= 1
    return np.cumsum(cover[:n]) == 0


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's periodic variant of every tenth document: from word a on, words repeat with period p."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit, times = words[a:a + p], -(-(n - a) // p)
    return words[:a] + (unit * times)[:n - a]



def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start,length,period>>, text): each row's runs and its text without the
    repeats (kept words joined by one space).

    A null text has no words and no runs; a null id stays null; repeated rows are handled one by
    one.  `plant` first makes every tenth document periodic (for tests and the query).
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            n, found, texts = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                words = planted(words, doc_id) if plant else words
                got = runs(word_ids(words))
                if got:
                    words_kept = [words[i] for i in np.flatnonzero(kept_words(len(words), got)).tolist()]
                else:
                    words_kept = words
                n.append(len(words))
                found.append([{"start": s, "length": m, "period": q} for s, m, q in got])
                texts.append(b" ".join(words_kept))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")


def op13_rows(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the runs and the collapsed texts of `find_runs`."""
    found = find_runs(docs, plant=True)
    # longest first; ties: smallest start, then smallest period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    digest = F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256)
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"),
        F.col("top.length").alias("length"), (-F.col("top.p")).alias("period"),
        F.expr("1000 * top.length div -top.p").alias("exponent_milli"), digest.alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_rows(read_table(spark, sf_dir, "documents"))
