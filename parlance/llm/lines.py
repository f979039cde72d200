"""Fuzzy line dedup by MinHash: one line stays of each component of near-equal lines.

1. Every non-blank line is signed inside the tasks that read the documents: `BINS` bins of one
   permutation of its distinct character shingles (`SHINGLE` characters), empty bins filled by
   re-hashed neighbours, folded into `BANDS` band hashes of `ROWS` bins.  Equal lines are one row
   from here on (pre-aggregated by content hash).
2. Lines with an equal band meet in one shuffle; a task reads its bands in order and passes the distinct
   member sets on, not pairs.  Large bands are dealt out in buckets of bounded size (`bounded_buckets`).
3. The members of a set are compared by their sketches (`SKETCH_BITS` bits of each bin) first: two lines of
   which fewer than `LEAST_EQUAL` bins are equal are not near-equal.  What is left is united to clusters,
   so that a line's text travels once; the texts are fetched, and each cluster (or, of a large one, its
   part of each member set) is verified by exact Jaccard similarity of the shingle sets (at least
   `SIMILARITY`).  A line already linked is not compared again, and a spanning forest of links leaves the task.
4. Distributed union-find labels the components.  The line that stays is, of the component's lines
   in the document with the smallest id, the first one.

Lines shorter than a shingle are one shingle.  Blank lines are layout: they take no part and stay.
A line is named by a 64-bit hash of its content; n distinct lines meet a collision with about
n^2 / 2^65 probability.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import (BYTE_CODES, SPACE, U64, bounded_buckets, connected_components, discard, enter, forest, mix,
                                 put_back, read_table, rest_of, small, span_hashes, stored, streamed_groups, text_slices)

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
BINS = BANDS * ROWS
#: A sketch is so many bits of each bin.  Two lines at the threshold that share a band have 39.8 equal bins on average, with a
#: standard deviation of 2.6: they fall below LEAST_EQUAL about three times in a million (the bands miss two in a thousand).
SKETCH_BITS, LEAST_EQUAL = 4, 27
SKETCH = [f"s{i}" for i in range(BINS * SKETCH_BITS // 64)]
BLOCK_LINES = 128
#: Lines of a band beyond which it is dealt out in blocks; how many lines make one sampled line; most bands told beforehand.
LARGE = 2 * BLOCK_LINES
SAMPLED, HOT_BANDS = 64, 20_000
NEWLINE = 10
#: Shared shingles that are counted in one matrix product.
COLUMNS = 2048


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of all rows, in order, and each row's first line."""
    cut = np.flatnonzero(data == NEWLINE)
    starts = np.concatenate((off[:-1], cut + 1))
    ends = np.concatenate((off[1:], cut))
    starts, ends = np.sort(starts, kind="stable"), np.sort(ends, kind="stable")
    return starts, ends, np.searchsorted(cut, off) + np.arange(len(off))


def line_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit content hashes of lines; 0 for blank lines."""
    h = span_hashes(BYTE_CODES[0][data], starts, ends)
    ink = np.concatenate(([0], np.cumsum(~SPACE[data])))
    return np.where(ink[ends] > ink[starts], np.where(h == 0, U64(1), h), U64(0))


def shingle_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of all character shingles; a line of fewer characters is one shingle.

    Characters are UTF-8 code points: positions are the bytes that begin one.
    """
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    bound = np.append(begin, len(data))
    a, b = np.searchsorted(begin, starts), np.searchsorted(begin, ends)
    n = np.maximum(b - a - SHINGLE + 1, 1)
    line = np.repeat(np.arange(len(starts)), n)
    k = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n) + a[line]
    return span_hashes(BYTE_CODES[1][data], bound[k], bound[np.minimum(k + SHINGLE, b[line])], 1), line


def signatures(h: np.ndarray, line: np.ndarray, n_lines: int) -> np.ndarray:
    """(n_lines x BINS) smallest values of the bins from all lines' shingle hashes."""
    empty = np.iinfo(np.uint64).max
    sig = np.full(n_lines * BINS, empty, U64)
    cell = line * BINS + ((h >> U64(32)) * U64(BINS) >> U64(32)).astype(np.int64)
    np.minimum.at(sig, cell, mix(h + U64(77)) >> U64(1))
    sig = sig.reshape(n_lines, BINS)
    # an empty bin takes a bin chosen by a fixed sequence of the bin and the attempt; rows that are
    # full leave the loop
    todo = np.flatnonzero((sig == empty).any(axis=1))
    have, attempt = sig[todo], 0
    fill, hole = have.copy(), have == empty
    while len(todo):
        attempt += 1
        src = (mix(np.arange(BINS, dtype=U64) * U64(1009) + U64(attempt)) % U64(BINS)).astype(np.int64)
        got = have[:, src]
        use = hole & (got != empty)
        fill[use] = mix(got[use] + U64(attempt))
        hole &= ~use
        full = ~hole.any(axis=1)
        if full.any():
            sig[todo[full]] = fill[full]
            todo, have, fill, hole = todo[~full], have[~full], fill[~full], hole[~full]
    return sig


def band_hashes(h: np.ndarray, line: np.ndarray, n_lines: int) -> np.ndarray:
    """(n_lines x BANDS) band hashes from all lines' shingle hashes."""
    return bands_of_bins(signatures(h, line, n_lines))


def bands_of_bins(sig: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sig), BANDS), U64)
    for r in range(ROWS):
        out = mix(out * U64(31) + sig[:, r::ROWS] + U64(r + 1))
    return mix(out + np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """(n_lines x len(SKETCH)) words of SKETCH_BITS bits of each bin."""
    per = 64 // SKETCH_BITS
    out = np.zeros((len(sig), len(SKETCH)), U64)
    for k in range(per):
        out |= (sig[:, k::per] & U64((1 << SKETCH_BITS) - 1)) << U64(SKETCH_BITS * k)
    return out.view(np.int64)


def equal_bins(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bins of two sketches (rows of U64 words, in step) are equal."""
    x = a ^ b
    for s in (1, 2):
        x |= x >> U64(s)
    return BINS - np.bitwise_count(x & U64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, doc_id, b0 .., s0 ..) of every distinct non-blank line of each slice of documents."""
    enter("lines")
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for row, data, off in text_slices(b.column(1)):
            starts, ends, first = line_spans(data, off)
            h = line_ids(data, starts, ends)
            doc = ids[row + np.repeat(np.arange(len(off) - 1), np.diff(first))].astype(np.int64)
            order = np.lexsort((doc, h))
            keep = order[np.flatnonzero(np.diff(h[order], prepend=U64(0)) != 0)]   # smallest document of each line
            if not len(keep):
                continue
            sh, line = shingle_hashes(data, starts[keep], ends[keep])
            sig = signatures(sh, line, len(keep))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[keep].view(np.int64)), pa.array(doc[keep]),
                 *(pa.array(x) for x in (*bands_of_bins(sig).T.copy(), *sketches(sig).T.copy()))],
                ["line", "doc_id", *(f"b{i}" for i in range(BANDS)), *SKETCH])


def signed_lines(docs: DataFrame) -> DataFrame:
    """(line, doc_id, b0 .., s0 ..): each distinct line of docs(doc_id, text) with its smallest document."""
    bands = [*(f"b{i}" for i in range(BANDS)), *SKETCH]
    rows = docs.where("doc_id is not null").mapInArrow(
        _sign, "line long, doc_id long, " + ", ".join(f"{b} long" for b in bands))
    return rows.groupBy("line").agg(F.min("doc_id").alias("doc_id"), *(F.min(b).alias(b) for b in bands))


def _member_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, members) of the buckets of a partition sorted by bucket that hold two lines or more."""
    sets, members = [], []
    for g in streamed_groups(batches, "bucket"):
        ids = np.unique(g.column("line").to_numpy())
        if len(ids) > 1:
            sets.append(int(mix(span_hashes(ids.view(U64), np.array([0]), np.array([len(ids)])))[:1].view(np.int64)[0]))
            members.append(ids)
        if len(sets) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(members, pa.list_(pa.int64()))],
                                             ["set", "members"])
            sets, members = [], []
    if sets:
        yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(members, pa.list_(pa.int64()))],
                                         ["set", "members"])


def _texts_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, wanted lines, the group of each) -> (group, line, text of the line)."""
    for b in batches:
        wanted, groups = b.column(1), b.column(2)
        for row, data, off in text_slices(b.column(0)):
            starts, ends, first = line_spans(data, off)
            h = line_ids(data, starts, ends).view(np.int64)
            sets, lines, texts = [], [], []
            for d in range(len(off) - 1):
                want: dict[int, list[int]] = {}
                for x, g in zip(wanted[row + d].as_py() or (), groups[row + d].as_py() or ()):
                    want.setdefault(x, []).append(g)
                for i in range(first[d], first[d + 1]):
                    x = int(h[i])
                    for g in want.pop(x, ()):
                        sets.append(g)
                        lines.append(x)
                        texts.append(data[starts[i]:ends[i]].tobytes().decode("utf-8", "replace"))
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(lines, pa.int64()), pa.array(texts, pa.string())],
                                                 ["set", "line", "line_text"])


def similar_forest(texts: pa.Array, similarity: float = SIMILARITY) -> np.ndarray:
    """For each of a few lines the first line of its component under exact Jaccard similarity."""
    shingles: list[np.ndarray] = []
    for row, data, off in text_slices(texts):
        h, line = shingle_hashes(data, off[:-1], off[1:])
        shingles += [np.unique(x) for x in np.split(h, np.flatnonzero(np.diff(line)) + 1)]
    size = np.array([len(s) for s in shingles])
    all_, owner = np.concatenate(shingles), np.repeat(np.arange(len(size)), size)
    order = np.argsort(all_, kind="stable")
    all_, owner = all_[order], owner[order]
    # shingles of one line only are common to none
    first = np.flatnonzero(np.diff(all_, prepend=all_[0] - U64(1)))
    n = np.diff(np.append(first, len(all_)))
    shared, owner = np.repeat(np.arange((n > 1).sum()), n[n > 1]), owner[np.repeat(n > 1, n)]
    common = np.zeros((len(size), len(size)), np.float32)
    for c in range(0, int(shared[-1]) + 1 if len(shared) else 0, COLUMNS):
        lo, hi = np.searchsorted(shared, (c, c + COLUMNS))
        has = np.zeros((len(size), COLUMNS), np.float32)
        has[owner[lo:hi], shared[lo:hi] - c] = 1
        common += has @ has.T
    similar = common >= similarity * (size[:, None] + size[None].astype(float) - common)
    return forest(len(size), lambda i, rest: similar[i, rest])


def similar_pairs(texts: pa.Array, similarity: float = SIMILARITY) -> np.ndarray:
    """For rows 2i and 2i + 1 of `texts` whether their exact Jaccard similarity is high enough.

    Shingle hashes are cut to 48 bits beside the row (or pair) number, so that two plain sorts
    give the set sizes and the common shingles of all pairs.
    """
    out = np.zeros(len(texts) // 2, bool)
    for p in range(0, len(out), 8192):
        rows = texts.slice(2 * p, 2 * min(8192, len(out) - p))
        keys = []
        for row, data, off in text_slices(rows):
            h, line = shingle_hashes(data, off[:-1], off[1:])
            keys.append((line + row).astype(U64) << U64(48) | h >> U64(16))
        k = np.sort(np.concatenate(keys))
        k = k[np.concatenate(([True], k[1:] != k[:-1]))]
        size = np.bincount((k >> U64(48)).astype(np.int64), minlength=len(rows))
        both = np.sort((k >> U64(49) << U64(48)) | (k & U64((1 << 48) - 1)))
        twice = both[1:][both[1:] == both[:-1]]
        common = np.bincount((twice >> U64(48)).astype(np.int64), minlength=len(rows) // 2)
        out[p:p + len(rows) // 2] = common >= similarity * (size[::2] + size[1::2] - common)
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the member sets of a partition sorted by set; sets of two are verified together."""
    u: list[int] = []
    v: list[int] = []
    twos: list[pa.Table] = []

    def pairs() -> None:
        t = pa.concat_tables(twos).combine_chunks()
        ids = t.column("line").to_numpy()
        ok = similar_pairs(t.column("line_text").combine_chunks())
        u.extend(ids[::2][ok].tolist())
        v.extend(ids[1::2][ok].tolist())
        twos.clear()

    def links() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        u.clear(), v.clear()
        return out

    for g in streamed_groups(batches, "set"):
        if g.num_rows == 2:
            twos.append(g)
            if len(twos) >= 2048:
                pairs()
        else:
            ids = g.column("line").to_numpy()
            root = similar_forest(g.column("line_text"))
            hit = np.flatnonzero(root != np.arange(len(root)))
            u.extend(ids[root[hit]].tolist())
            v.extend(ids[hit].tolist())
        if len(u) > 1 << 15:
            yield links()
    if twos:
        pairs()
    if u:
        yield links()


def _sets_or_large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, members, band) from a partition sorted by band: the lines of each band with two of them or more; the lines
    of a band with more than LARGE go on in pieces that name the band (no set), so that no task holds it."""
    held, large = (np.zeros(0, np.int64),) * 2, None    # the band left open by the last batch, and the large one it is part of

    def out(k: np.ndarray, line: np.ndarray) -> pa.RecordBatch | None:
        """Of whole bands (or pieces of large ones), adjacent: those with two lines or more."""
        first = np.flatnonzero(np.diff(k, prepend=k[0] - 1))
        size = np.diff(np.append(first, len(k)))
        piece = (size > LARGE) | (k[first] == large if large is not None else False)
        some = (size > 1) | piece
        if not some.any():
            return None
        is_large, some = piece[some], np.repeat(some, size)
        k, line = k[some], line[some]
        new = np.diff(k, prepend=k[0] - 1) != 0
        order = np.lexsort((line, np.cumsum(new)))
        line = line[order]
        once = new | (np.diff(line, prepend=line[0] - 1) != 0)      # equal lines of a band count once
        k, line, new = k[once], line[once], new[once]
        first = np.flatnonzero(new)
        ends = np.append(first[1:], len(k))
        ids = mix(span_hashes(line.view(U64), first, ends)).view(np.int64)
        members = pa.ListArray.from_arrays(pa.array(np.append(first, len(k)).astype(np.int32)), pa.array(line))
        b = pa.RecordBatch.from_arrays([pa.array(ids, mask=is_large), members, pa.array(k[first], mask=~is_large)], ["set", "members", "band"])
        return b.filter(pa.array(is_large | (ends - first > 1)))

    for b in batches:
        if not b.num_rows:
            continue
        k, line = (np.concatenate((h, b.column(i).to_numpy())) for i, h in enumerate(held))
        last = int(np.searchsorted(k, k[-1]))
        if len(k) - last > LARGE or k[-1] == large:    # a piece of a large band goes on at once
            last = len(k)
        if last:
            found = out(k[:last], line[:last])
            if found is not None:
                yield found
        large = int(k[-1]) if last == len(k) else None
        held = k[last:], line[last:]
    if len(held[0]):
        found = out(*held)
        if found is not None:
            yield found


def _near_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) links between the lines of each set of a partition sorted by set, (set, line, s0 ..), that are near by their sketches."""
    u, v = [], []

    def near(lines: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        ok = equal_bins(words[i], words[j]) >= LEAST_EQUAL
        u.append(lines[i[ok]])
        v.append(lines[j[ok]])

    held = None
    for b in chain(batches, (None,)):
        if b is not None and not b.num_rows:
            continue
        t = [np.zeros(0, np.int64)] * b.num_columns if b is not None and held is None else held
        if b is not None:
            t = [np.concatenate((h, c.to_numpy())) for h, c in zip(t, b.columns)]
        if t is None or not len(t[0]):
            continue
        k = t[0]
        end = int(np.searchsorted(k, k[-1])) if b is not None else len(k)
        held = [c[end:] for c in t]
        lines, words = t[1][:end], np.stack([c[:end] for c in t[2:]], axis=1).view(U64)
        first = np.flatnonzero(np.diff(k[:end], prepend=k[0] - 1))
        size = np.diff(np.append(first, end))
        for d in range(1, 8):       # small sets pair by pair, all of them at once
            i = np.flatnonzero(np.repeat(size <= 8, size))
            i = i[i + d < end]
            i = i[k[i + d] == k[i]]
            if len(i):
                near(lines, words, i, i + d)
        for a, m in zip(first[size > 8].tolist(), size[size > 8].tolist()):
            w = words[a:a + m]
            root = forest(m, lambda i, rest, w=w: equal_bins(w[i], w[rest]) >= LEAST_EQUAL)
            hit = np.flatnonzero(root != np.arange(m))
            u.append(lines[a + root[hit]])
            v.append(lines[a + hit])
        if sum(map(len, u)) > 1 << 15:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])
            u, v = [], []
    if any(map(len, u)):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])


def line_sets(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Stored (set, members): the sets of lines that share a band, each once.

    All bands are shuffled once.  Bands with a large share of the lines are known beforehand from one
    line in SAMPLED (at most HOT_BANDS of them, by the threshold), and bands that turn out large
    are passed on by the task that meets them; only these two are counted and dealt out in blocks
    (`bounded_buckets`).
    """
    banded = lines.select("line", F.explode(F.array(*(f"b{i}" for i in range(BANDS)))).alias("band"))
    least = max(16, lines.count() * BANDS // SAMPLED // HOT_BANDS)
    hot = stored(spark, banded.where(F.pmod(F.xxhash64("line", F.lit(21)), F.lit(SAMPLED)) == 0).groupBy("band").count()
                 .where(F.col("count") > least).select("band", F.lit(True).alias("hot")), "hot-bands")
    told = banded.join(F.broadcast(hot), "band", "left")
    found = stored(spark, told.where("hot is null").select("band", "line").repartition("band").sortWithinPartitions("band")
                   .mapInArrow(_sets_or_large, "set long, members array<long>, band long"), "band-sets")
    large = found.where("band is not null").select("band", F.explode("members").alias("line")).unionByName(
        told.where("hot").select("band", "line"))
    blocks = bounded_buckets(spark, large, "band", "line", BLOCK_LINES).select("bucket", "line") \
        .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_member_sets, "set long, members array<long>")
    sets = stored(spark, found.where("band is null").select("set", "members").unionByName(blocks).dropDuplicates(["set"]), "line-set-lists")
    discard(found)
    return sets


def near_links(lines: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): links between lines that share a set and are near by their sketches; they span what is near."""
    member = sets.select("set", F.explode("members").alias("line"))
    return member.join(lines.select("line", *SKETCH), "line").select("set", "line", *SKETCH) \
        .repartition("set").sortWithinPartitions("set").mapInArrow(_near_members, "u long, v long")


def verify_groups(spark: SparkSession, lines: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, line): groups of lines to verify.

    Lines that share sets share many of them, and a line's text should travel once: lines that are near by their
    sketches are united to clusters by distributed union-find, and a cluster of at most LARGE lines is
    one group.  Of larger clusters the lines of each set are groups themselves.
    """
    cluster = connected_components(spark, near_links(lines, sets))
    cluster = stored(spark, cluster.select(F.col("node").alias("line"), "root"), "line-clusters")
    size = cluster.groupBy("root").count()
    whole = cluster.join(size.where(F.col("count") <= LARGE).select("root"), "root").select(F.col("root").alias("set"), "line")
    large = cluster.join(size.where(F.col("count") > LARGE).select("root"), "root").select("line", "root")
    parts = sets.select("set", F.explode("members").alias("line")).join(large, "line") \
        .select(F.xxhash64("set", "root").alias("set"), "line")
    return stored(spark, whole.unionByName(parts), "line-groups")


def line_links(spark: SparkSession, docs: DataFrame, lines: DataFrame, member: DataFrame) -> DataFrame:
    """(u, v) verified links between distinct lines that span their components; `member(set, line)` are the groups to verify.

    The home document of each line is told which groups want it, so that texts are shuffled to their
    groups at once.  Documents that repeat an id send a line twice; it links with itself then.
    """
    wanted = lines.select("line", "doc_id").join(member, "line") \
        .groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("line").alias("wanted"), F.collect_list("set").alias("sets"))
    return docs.join(wanted, F.col("doc_id") == F.col("id")).select("text", "wanted", "sets") \
        .mapInArrow(_texts_of_lines, "set long, line long, line_text string").repartition("set").sortWithinPartitions("set", "line") \
        .mapInArrow(_verify, "u long, v long").where("u <> v")


def _rebuild(keep_text: bool):
    """Rows (doc_id, text, kept: list of (line, component), ...) -> what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("lines")
        for b in small(batches):
            n, gone, out = [0] * b.num_rows, [0] * b.num_rows, [None] * b.num_rows
            known = b.column(0).is_valid().to_pylist()
            lines, comps = b.column(2), b.column(3)
            for row, data, off in text_slices(b.column(1)):
                starts, ends, first = line_spans(data, off)
                h = line_ids(data, starts, ends).view(np.int64)
                for d in range(len(off) - 1):
                    r, span = row + d, range(first[d], first[d + 1])
                    comp, seen, left = dict(zip(lines[r].as_py() or (), comps[r].as_py() or ())), set(), []
                    for i in span:
                        x = int(h[i])
                        if x and known[r]:
                            c = comp.get(x)
                            if c is None or c in seen:
                                continue
                            seen.add(c)
                        left.append(data[starts[i]:ends[i]].tobytes())
                    n[r], gone[r] = len(span), len(span) - len(left)
                    out[r] = b"\n".join(left)
            given = b.column(1).is_valid().to_pylist()
            done = [hashlib.sha256(t or b"").hexdigest() if not keep_text else (t or b"").decode("utf-8", "replace") if g
                    else None for t, g in zip(out, given)]
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(done, pa.string())]
            names = ["doc_id", "n_lines", "n_removed", "text" if keep_text else "kept_sha256"]
            if keep_text:
                arrays, names = [*arrays, b.column(4)], [*names, "row"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def line_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For docs(doc_id, text): (stored distinct lines, (line, component) of lines with near-equals)."""
    spark = docs.sparkSession
    signed = stored(spark, signed_lines(docs), "signed-lines")
    sets = line_sets(spark, signed)
    member = verify_groups(spark, signed, sets)
    lines = stored(spark, signed.select("line", "doc_id"), "lines")
    discard(signed, sets)
    cc = connected_components(spark, line_links(spark, docs, lines, member))
    return lines, cc.select(F.col("node").alias("line"), F.col("root").alias("component"))


def _deduplicated(docs: DataFrame, id_col: str, text_col: str, keep_text: bool) -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *([rest_of(docs, text_col).alias("row")] if keep_text else []))
    lines, component = line_components(base.select("doc_id", "text"))
    named = lines.select("line", "doc_id").join(component, "line", "left")
    grouped = named.where("component is not null")
    home = grouped.groupBy("component").agg(F.min("doc_id").alias("home")).withColumnRenamed("component", "c")
    kept = named.where("component is null").select("doc_id", "line", F.col("line").alias("component")).unionByName(
        grouped.join(home, F.col("component") == F.col("c")).where("doc_id = home").select("doc_id", "line", "component"))
    of_doc = kept.groupBy(F.col("doc_id").alias("id")).agg(
        F.collect_list(F.struct("line", "component")).alias("kept"))
    told = base.join(of_doc, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "text", F.col("kept.line").alias("lines"), F.col("kept.component").alias("components"),
        *(["row"] if keep_text else []))
    schema = "doc_id long, n_lines long, n_removed long, " + ("text string" if keep_text else "kept_sha256 string")
    if keep_text:
        schema += ", row " + base.schema["row"].dataType.simpleString()
    return told.mapInArrow(_rebuild(keep_text), schema)


def line_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) per row; kept lines joined by a newline.

    A null text is the empty text, which is one blank line.  A row with a null id is left as it is.
    Rows that repeat an id are alike: what stays for the id stays in each of them.
    """
    return _deduplicated(docs, id_col, text_col, keep_text=False)


def drop_similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns as they were, without the lines that another line stands for."""
    return put_back(_deduplicated(docs, id_col, text_col, keep_text=True), docs, text_col)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(read_table(spark, sf_dir, "documents"))
