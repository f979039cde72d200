"""Shared pieces of the training-data operators: scratch tables, bounded buckets, streamed
groups, distributed union-find and numpy word hashing over Arrow string buffers.

Conventions of the whole subpackage
* An operator reads only the columns it is told to read, under names of its own; extra columns
  never clash with it.
* A null text is the empty text.  A row with a null id takes no part in grouping.
* Intermediate tables lie under `spark.checkpoint.dir` (see `parlance.session.scratch_path`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import scratch_path

U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lets Spark delete the shuffles of an execution when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write `df` once to the shared scratch folder and read it back (lineage ends here).

    Nothing reads the shuffles of the writing job again; they go when it ends, not when the driver happens to
    collect its garbage.
    """
    path = scratch_path(spark, tag)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes `stored` tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: list[str], base: str) -> str:
    """A column name that no column of `taken` has (names compare without case)."""
    low, name = {c.lower() for c in taken}, base
    while name.lower() in low:
        name += "_"
    return name


def held_out(id_col: Column) -> Column:
    """True for the fold that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def keep_rows(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of `docs` whose id is in `ids(id)`; one row stays of rows that repeat an id.

    Rows with a null id stay: nothing can name them as another row's copy.
    """
    rn, key = fresh(docs.columns, "_nth"), fresh(docs.columns, "_id")
    from pyspark.sql import Window

    named = docs.where(F.col(id_col).isNotNull()).join(
        ids.select(F.col(ids.columns[0]).alias(key)).distinct(), F.col(id_col) == F.col(key), "left_semi")
    others = [F.col(f"`{c}`").cast("string") for c in docs.columns if c != id_col]
    w = Window.partitionBy(id_col).orderBy(F.xxhash64(*others) if others else F.lit(0))
    first = named.withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).drop(rn)
    return first.unionByName(docs.where(F.col(id_col).isNull()))


def rest_of(docs: DataFrame, text_col: str) -> Column:
    """All columns but the text as one struct, to go through a Python step beside the text."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), F.lit(0).alias(fresh(docs.columns, "_0")))


def put_back(done: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of `docs` from (text, row = rest_of(docs))."""
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))


# --- buckets -----------------------------------------------------------------------------------

def bounded_buckets(spark: SparkSession, rows: DataFrame, key: str, item: str, limit: int) -> DataFrame:
    """Replace column `key` by `bucket` so that no bucket holds much over 2 x `limit` rows while any
    two rows of one key still meet in some bucket.

    A key with more than `limit` rows is split at random (by the item's hash) into blocks, and a
    bucket is a pair of blocks.  Counting is pre-aggregated; the few large keys are stored, so that
    the join broadcasts them when they are small and is split by AQE when they are not.
    """
    big = stored(spark, rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
                 .select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_nb")), "large-keys")
    block = F.pmod(F.xxhash64(F.col(item), F.lit(7)), F.col("_nb"))
    subs = F.when(F.col("_nb").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("_nb") - 1),
                    lambda o: (F.least(o, F.col("_b")) * F.col("_nb") + F.greatest(o, F.col("_b"))).cast("long")))
    return (rows.join(big, key, "left").withColumn("_b", block)
            .withColumn("_sub", F.explode(subs))
            .withColumn("bucket", F.xxhash64(F.col(key), F.col("_sub")))
            .drop(key, "_n", "_nb", "_b", "_sub"))


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of a few rows, for steps that make Python objects of whole texts."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def streamed_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 2) -> Iterator[pa.Table]:
    """Groups (equal, adjacent keys) of at least `least` rows from a partition sorted by `key`.

    Only the open group is held besides the current batch; groups must be bounded.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        k = t.column(key).to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        edges = np.concatenate(([0], cuts))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a >= least:
                yield t.slice(a, b - a)
        held = t.slice(int(edges[-1]))
    if held is not None and held.num_rows >= least:
        yield held


def forest(n: int, linked) -> np.ndarray:
    """Smallest index of each of n items' component; `linked(i, rest)` tells which of `rest` link
    with item i.  Each item is expanded once, against the items not reached so far."""
    root, rest = np.arange(n), np.ones(n, bool)
    for s in range(n):
        if not rest[s]:
            continue
        rest[s] = False
        queue = [s]
        while queue:
            i = queue.pop()
            cand = np.flatnonzero(rest)
            if not len(cand):
                break
            hit = cand[linked(i, cand)]
            root[hit] = s
            rest[hit] = False
            queue.extend(hit.tolist())
    return root


# --- distributed union-find ---------------------------------------------------------------------

def smallest(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Stored (x, m): the smallest neighbour b of each node a of `edges(a, b)`."""
    return stored(spark, edges.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("m")), "cc-low")


def with_smallest(spark: SparkSession, edges: DataFrame, end: str, how: str = "inner", low: DataFrame | None = None) -> DataFrame:
    """`edges(a, b)` with `m`, the smallest neighbour b of the node at the given end."""
    return edges.join(smallest(spark, edges) if low is None else low, F.col(end) == F.col("x"), how)


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges(u, v)`; root is the smallest node it reaches.

    Alternates two contractions, each a pre-aggregated minimum and a join:
    every edge a -> b (b < a) is redirected to b's smallest neighbour, then the smaller
    neighbours of each node are hung below the smallest of them.  The edges end as stars.  The
    minima are written before they are joined: AQE splits the edges of a hub only where both sides
    of the join are plain shuffles.  Each half round is a written table, so a lost executor costs
    one of them at most; it is deleted when the next one is there.
    """
    e = stored(spark, edges.where("u <> v").select(
        F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "cc")
    before = None
    while True:
        low = smallest(spark, e)
        jumped = stored(spark, with_smallest(spark, e, "b", "left", low).select("a", F.coalesce("m", "b").alias("b")), "cc")
        discard(e, low)
        low = smallest(spark, jumped)
        hung = with_smallest(spark, jumped, "a", low=low).select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = stored(spark, hung.select("e.a", "e.b").where("a <> b").distinct(), "cc")
        discard(jumped, low)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


# --- what a reused worker process holds ---------------------------------------------------------

held: dict[str, object] = {}
_step = ""


def enter(step: str) -> None:
    """Called in a worker at the start of a step.  Worker processes are reused; large tables that
    another operator left in this one are let go."""
    global _step
    if step != _step:
        import gc

        _step = step
        held.clear()
        _powers.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


# --- words of Arrow strings ---------------------------------------------------------------------

_rng = np.random.default_rng(20240229)
#: Odd factors and byte codes of two independent 64-bit polynomial hashes.
FACTORS = (_rng.integers(0, 2**63, 2, dtype=U64) << U64(1)) | U64(1)
BYTE_CODES = _rng.integers(1, 2**63, (2, 256), dtype=U64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of a factor (or of its inverse modulo 2^64); kept and grown as needed."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        f = int(FACTORS[which])
        f = pow(f, -1, 2**64) if inverse else f
        have = np.full(max(n, 1 << 16), U64(f))
        have[0] = 1
        have = _powers[(which, inverse)] = np.multiply.accumulate(have)
    return have[:n]


def text_slices(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets in them) of consecutive rows with about `most_bytes` together."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + most_bytes, "right")) - 1))
        yield a, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) and, per row, the first word."""
    inside = ~SPACE[data]
    brk = np.zeros(len(data) + 1, bool)
    brk[off] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | brk[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | brk[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, cuts=()):
    """Polynomial hashes of the spans [starts, ends) of a sequence of 64-bit codes; with `cuts` (other
    ends of the same spans) a list of hashes, one array per end."""
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * powers(which, len(codes)), out=sums[1:])
    base, back = sums[starts], powers(which, len(codes) + 1, True)[starts]
    out = [mix((sums[e] - base) * back) for e in (ends, *cuts)]
    return out if cuts else out[0]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return span_hashes(BYTE_CODES[which][data], starts, ends, which)
