"""Line dedup leaves little on the disk: shuffles and superseded tables go, and only near lines send their texts."""

import os
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parlance.llm import lines as L
from parlance.llm.common import connected_components, discard, stored
from tests.llm.test_short_lines import edited, grams


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def tables(spark):
    return {p for p in os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:"))}


def test_shuffles_of_a_stored_table_go(spark):
    before = shuffle_files(spark)
    df = stored(spark, spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "freed")
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and df.count() == 7 and df.agg(F.sum("count")).first()[0] == 1000


def test_rounds_leave_one_table(spark):
    before = tables(spark)
    edges = [(i, i + 1) for i in range(100)] + [(500, 501)]
    roots = connected_components(spark, spark.createDataFrame(edges, "u long, v long"))
    left = tables(spark) - before
    assert len(left) == 1 and {r.root for r in roots.collect()} == {0, 500}
    table = stored(spark, spark.range(3), "mine")
    discard(table)
    assert tables(spark) - before == left


def test_tables_of_line_dedup_go(docs_of):
    docs = docs_of([(i, edited(i % 40)[i // 40]) for i in range(80)])
    spark = docs.sparkSession
    before = tables(spark)
    assert L.line_digests(docs).where("n_removed > 0").count() > 25
    left = {p.rsplit("-", 1)[0] for p in tables(spark) - before}
    assert not left & {"signed-lines", "line-set-lists", "band-sets", "cc-low"}


def test_sketches_tell_near_lines(spark):
    """Every near pair of a set stays linked, whatever the size of the set; other lines are not."""
    texts = [x for s in range(240) for x in edited(s)]
    arr = pa.array(texts)
    _, data, off = next(L.text_slices(arr))
    sig = L.signatures(*L.shingle_hashes(data, off[:-1], off[1:]), len(texts))
    sketch = L.sketches(sig)
    assert L.equal_bins(sketch.view(np.uint64), sketch.view(np.uint64)).tolist() == [L.BINS] * len(texts)
    lines = spark.createDataFrame([(i, *map(int, sketch[i])) for i in range(len(texts))],
                                  "line long, " + ", ".join(f"{c} long" for c in L.SKETCH))
    near = [i for i in range(0, len(texts), 2) if len(grams(texts[i]) & grams(texts[i + 1])) >= 0.8 * len(grams(texts[i]) | grams(texts[i + 1]))]
    assert len(near) > 150
    for size in (2, 6, 80):
        sets = spark.createDataFrame([(k, list(range(k, k + size))) for k in range(0, len(texts), size)], "set long, members array<long>")
        links = {tuple(sorted(r)) for r in L.near_links(lines, sets).collect()}
        assert {(i, i + 1) for i in near} <= links
        assert all(b == a + 1 and a % 2 == 0 for a, b in links)
