"""Exact substring dedup by recompression.

Recompression rewrites every document's word sequence in rounds: short runs of one symbol, then
pairs (a, b) whose symbols fall on the left and the right side of a random split of the alphabet,
become one new symbol.  A new symbol's name is a fixed 64-bit function of its parts, so all tasks
give one name to one content without exchanging tables, and a round reads a symbol's neighbours
only.  Joins are bounded by length (`ROUNDS`), therefore a boundary between symbols depends on at
most `CONTEXT` words on either side: equal substrings have the same symbols inside, up to that margin.

High-level symbols are chains of consecutive symbols of `CHAIN` words or a little more that begin
at *anchors*: each window of 50 words has one, the symbol of smallest name that begins in its
middle (`REACH`), and so copies of a window have the same anchor and the same chain there.  Spark then

0. takes a whole document for one symbol: of equal texts all but the first lose every word;
1. finds the names that occur in two different texts or more (pre-aggregated, no pairs);
2. marks the windows whose high-level symbol is shared - a superset of the repeats;
3. verifies: groups these windows by a 128-bit hash of their words and takes the smallest id;
4. removes the words of every window that also starts in a document with a smaller id.

Nothing is quadratic: a passage in n documents costs n rows a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import (U64, enter, mix, put_back, read_table, rest_of, small, span_hashes, stored, text_slices,
                                 word_hashes, words)

WINDOW = 50
#: (kind, largest symbol in words that the step may join).
ROUNDS = (("run", 1), ("pair", 1), ("pair", 2), ("pair", 2))
#: A boundary's fate depends on so many words on either side: a run step looks at two symbols, a pair step at one.
CONTEXT = sum(2 * cap if kind == "run" else cap for kind, cap in ROUNDS)
LONGEST = 2 * max(cap for _, cap in ROUNDS)
CHAIN = 12
#: A window's anchor begins within so many word positions, from CONTEXT on; a chain from there ends
#: CONTEXT words before the window does, at the latest.
REACH = WINDOW - 2 * CONTEXT - (CHAIN + LONGEST - 1) + 1
assert REACH > LONGEST


def symbols(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and start words of the symbols after all rounds; `first` are the documents' first words
    (and, last, the number of words).  No symbol spans two documents."""
    name, at = codes, np.arange(len(codes))
    for step, (kind, cap) in enumerate(ROUNDS):
        n = len(name)
        if n < 2:
            break
        head = np.zeros(n + 1, bool)
        head[np.searchsorted(at, first)] = True
        small = np.diff(at, append=first[-1]) <= cap
        joined = small[:-1] & small[1:] & ~head[1:n]
        if kind == "run":
            same = joined & (name[:-1] == name[1:])
            joined = same.copy()
            joined[1:] &= ~same[:-1]          # runs of two; longer ones stay apart
            joined[:-1] &= ~same[1:]
        else:
            left = (mix(name + U64(step + 1)) & U64(1)) == 0
            joined &= left[:-1] & ~left[1:]
        i = np.flatnonzero(joined)
        name = name.copy()
        name[i] = mix(name[i] * U64(0x9E3779B97F4A7C15) + mix(name[i + 1] + U64(0x51ED270B + step)))
        keep = np.ones(n, bool)
        keep[i + 1] = False
        name, at = name[keep], at[keep]
    return name, at


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The minimum of x[i:i + size] for every i with a whole span, by doubling."""
    have, out = 1, x
    while have < size:
        shift = min(have, size - have)
        out = np.minimum(out[:-shift], out[shift:])
        have += shift
    return out


def high_symbols(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name and first word of the chains at anchors, in order; first word of every window and the
    position of its anchor among them).  Windows and chains lie within one document."""
    doc_end = np.repeat(first[1:], np.diff(first))
    window = np.flatnonzero(np.arange(WINDOW, len(codes) + WINDOW) <= doc_end)
    if not len(window):
        none = np.zeros(0, np.int64)
        return none.astype(U64), none, window, none
    name, at = symbols(codes, first)
    # rank by name; the leftmost of equal ranks is the anchor
    rank = np.full(len(codes), np.iinfo(np.uint64).max, U64)
    rank[at] = (mix(name ^ U64(0x2545F4914F6CDD1D)) >> U64(33) << U64(32)) | at.astype(U64)
    anchor = (sliding_min(rank, REACH)[window + CONTEXT] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    start = anchor[new]
    bound = np.append(at, len(codes))
    i, j = np.searchsorted(at, start), np.searchsorted(bound, start + CHAIN)   # up to the first boundary past CHAIN words
    return span_hashes(name, i, j), start, window, np.cumsum(new) - 1


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, doc_id, whole) of every document's high-level symbols, each once a document."""
    enter("substrings")
    for b in batches:
        ids, whole = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
        for row, data, off in text_slices(b.column(1)):
            ws, we, first = words(data, off)
            name, start, _, _ = high_symbols(word_hashes(data, ws, we), first)
            if not len(name):
                continue
            doc = np.searchsorted(first, start, "right") - 1
            order = np.lexsort((name, doc))
            name, doc = name[order], doc[order]
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(name[new].view(np.int64)), pa.array(ids[row + doc[new]].astype(np.int64)),
                 pa.array(whole[row + doc[new]].astype(np.int64))], ["name", "doc_id", "whole"])


def _ranges(at: np.ndarray) -> np.ndarray:
    """Sorted integers as (first, last + 1) ranges, flattened."""
    cut = np.flatnonzero(np.diff(at) != 1)
    return np.stack((at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + 1), 1).ravel()


def _from_ranges(r: np.ndarray) -> np.ndarray:
    return np.concatenate([np.arange(a, b) for a, b in r.reshape(-1, 2)]) if len(r) else np.zeros(0, np.int64)


def joined_words(text: str | None) -> tuple[int, bytes]:
    ws = (text or "").encode("utf-8", "surrogatepass").split()
    return len(ws), b" ".join(ws)


def _candidates(keep_text: bool):
    """Rows (doc_id, text, names, copy, row) -> candidate windows; copies and texts without any are
    finished here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            shared_of, copied, cand = b.column(2), b.column(3), [[] for _ in range(b.num_rows)]
            for row, data, off in text_slices(b.column(1)):
                known = [None if copied[row + d].as_py() else shared_of[row + d].as_py() for d in range(len(off) - 1)]
                if not any(known):
                    continue
                ws, we, first = words(data, off)
                name, start, window, which = high_symbols(word_hashes(data, ws, we), first)
                lo, hit = np.searchsorted(start, first), np.zeros(len(name), bool)
                for d, names in enumerate(known):
                    if names:
                        own = slice(lo[d], lo[d + 1])
                        hit[own] = np.isin(name[own].view(np.int64), np.array(names, np.int64))
                window = window[hit[which]]
                cut = np.searchsorted(window, first)
                for d in range(len(known)):
                    if cut[d] < cut[d + 1]:
                        cand[row + d] = _ranges(window[cut[d]:cut[d + 1]] - first[d]).tolist()
            n, gone, sha, left = [], [], [], []
            for text, c, copy in zip(b.column(1).to_pylist(), cand, b.column(3).to_pylist()):
                size, joined = (0, b"") if c or keep_text and not copy else joined_words(text)
                lost = size if copy and size >= WINDOW else 0
                n.append(size)
                gone.append(lost)
                sha.append(hashlib.sha256(b"" if lost else joined).hexdigest())
                left.append(cut_words(text, np.ones(size, bool)) if keep_text and lost else text if c or keep_text else None)
            arrays = [b.column(0), pa.array(left, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                      pa.array(sha, pa.string()), pa.array(cand, pa.list_(pa.int32()))]
            names = ["doc_id", "text", "n_words", "n_removed", "kept_sha256", "windows"]
            if keep_text:
                arrays, names = [*arrays, b.column(4)], [*names, "row"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, uid, doc_id, pos) of every candidate window."""
    for b in batches:
        uid, ids, windows = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)
        for row, data, off in text_slices(b.column(2)):
            ws, we, first = words(data, off)
            pos = [_from_ranges(np.array(windows[row + d].as_py(), np.int64)) for d in range(len(off) - 1)]
            size = np.array([len(p) for p in pos])
            at = np.concatenate([p + first[d] for d, p in enumerate(pos)])
            h = [span_hashes(word_hashes(data, ws, we, k), at, at + WINDOW, k).view(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[0]), pa.array(h[1]), pa.array(np.repeat(uid[row:row + len(size)], size).astype(np.int64)),
                 pa.array(np.repeat(ids[row:row + len(size)], size).astype(np.int64)),
                 pa.array(np.concatenate(pos).astype(np.int32))], ["h1", "h2", "uid", "doc_id", "pos"])


def removed_mask(n_words: int, starts: list[int] | None) -> np.ndarray:
    """Which words are covered by the windows that begin at `starts`."""
    d = np.zeros(n_words + 1, np.int64)
    if starts:
        s = np.array(starts)
        np.add.at(d, s, 1)
        np.add.at(d, s + WINDOW, -1)
    return np.cumsum(d)[:n_words] > 0


def cut_words(text: str, mask: np.ndarray) -> str:
    """The text without the masked words and the white space after each; the rest is unchanged."""
    if not mask.any():
        return text
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    nxt = np.append(starts[1:], len(data))
    drop = np.zeros(len(data) + 1, np.int64)
    np.add.at(drop, starts[mask], 1)
    np.add.at(drop, nxt[mask], -1)
    return data[np.cumsum(drop)[:-1] == 0].tobytes().decode("utf-8", "surrogatepass")


def _finish(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            n, gone, out = [], [], []
            for text, starts in zip(b.column(1), b.column(2)):
                text, starts = text.as_py() or "", starts.as_py()
                ws = text.encode("utf-8", "surrogatepass").split()
                mask = removed_mask(len(ws), starts)
                n.append(len(ws))
                gone.append(int(mask.sum()))
                if keep_text:
                    out.append(cut_words(text, mask))
                else:
                    kept = [w for w, m in zip(ws, mask.tolist()) if not m]
                    out.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "text" if keep_text else "kept_sha256"]
            if keep_text:
                arrays, names = [*arrays, b.column(3)], [*names, "row"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _repeats(docs: DataFrame, id_col: str, text_col: str, keep_text: bool) -> tuple[DataFrame, DataFrame]:
    """(stored rows with their candidate windows, (uid, starts) of the windows to remove)."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *([rest_of(docs, text_col).alias("row")] if keep_text else []))
    named_docs = base.where("doc_id is not null and text is not null").select(
        "doc_id", "text", F.xxhash64("text").alias("whole"), F.xxhash64(F.lit(1), "text").alias("whole2"))
    # the whole text as one symbol: the first of equal texts stands for the others
    whole = stored(spark, named_docs.select("doc_id", "whole", "whole2"), "whole-texts")
    tops = whole.groupBy("whole", "whole2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    copies = whole.join(tops, ["whole", "whole2"]).where("lo < doc_id") \
        .groupBy(F.col("doc_id").alias("cid")).agg(F.collect_set("whole").alias("copied"))
    named = named_docs.select("doc_id", "text", "whole").mapInArrow(_names, "name long, doc_id long, whole long")
    shared = named.groupBy("name").agg(F.min("whole").alias("lo"), F.max("whole").alias("hi")) \
        .where("lo < hi").select("name")
    of_doc = named.select("name", "doc_id").join(shared, "name").groupBy(F.col("doc_id").alias("id")) \
        .agg(F.collect_list("name").alias("names"))
    told = base.join(of_doc, F.col("doc_id") == F.col("id"), "left").join(copies, F.col("doc_id") == F.col("cid"), "left") \
        .withColumn("copy", F.coalesce(F.array_contains("copied", F.xxhash64("text")), F.lit(False)))
    schema = "doc_id long, text string, n_words long, n_removed long, kept_sha256 string, windows array<int>"
    if keep_text:
        schema += ", row " + base.schema["row"].dataType.simpleString()
    marked = told.select("doc_id", "text", "names", "copy", *(["row"] if keep_text else [])) \
        .mapInArrow(_candidates(keep_text), schema)
    marked = stored(spark, marked.withColumn("uid", F.monotonically_increasing_id()), "substring-candidates")
    hashed = marked.where(F.size("windows") > 0).select("uid", "doc_id", "text", "windows") \
        .mapInArrow(_window_hashes, "h1 long, h2 long, uid long, doc_id long, pos int")
    # the join alone tells a window that repeats, so that its last document is not shuffled beside the first
    first = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"))
    again = hashed.join(first, ["h1", "h2"]).where("lo < doc_id")
    return marked, again.groupBy("uid").agg(F.collect_list("pos").alias("starts"))


def substring_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row.

    A null text has no words.  Rows that repeat an id are documents of that id: they never remove
    each other's words.  A row with a null id neither removes nor loses words.
    """
    marked, gone = _repeats(docs, id_col, text_col, keep_text=False)
    done = marked.where(F.size("windows") == 0).select("doc_id", "n_words", "n_removed", "kept_sha256")
    rest = marked.where(F.size("windows") > 0).select("uid", "doc_id", "text").join(gone, "uid", "left") \
        .select("doc_id", "text", "starts") \
        .mapInArrow(_finish(False), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return done.unionByName(rest)


def drop_repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns as they were, with the repeated words cut out of their texts.

    What is kept keeps its white space; a text without repeats is unchanged.
    """
    marked, gone = _repeats(docs, id_col, text_col, keep_text=True)
    row_type = marked.schema["row"].dataType.simpleString()
    cut = marked.where(F.size("windows") > 0).select("uid", "doc_id", "text", "row").join(gone, "uid", "left") \
        .select("doc_id", "text", "starts", "row") \
        .mapInArrow(_finish(True), f"doc_id long, n_words long, n_removed long, text string, row {row_type}")
    both = marked.where(F.size("windows") == 0).select("row", "text").unionByName(cut.select("row", "text"))
    return put_back(both, docs, text_col)


def op5_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(read_table(spark, sf_dir, "documents"))
