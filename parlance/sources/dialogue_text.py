"""Dialogue text sources.

The dialogue file format: `k user<TAB>system` lines, an empty line between dialogues;
one-field lines are system-only turns (knowledge-base rows).

Files are scanned by byte ranges, line by line.  While it goes through a range, a task cuts it at the
empty lines, so one row is one dialogue from then on: no line is shuffled, sorted or joined.  Only the
two pieces at a range's ends (a dialogue may run on into the next range) are put together, two rows
per range.  Dialogues get their number in the file from prefix sums of the dialogues per range.

(The scan's own record separator cannot do this: with `\\n\\n` as separator a range that starts inside
three or more line ends pairs them differently from the range before, and a record comes twice.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import let
from ..operators.ordinals import ordinal_within
from ..session import scratch_path
from .corpus import SPLIT_ORDER, split_rank

#: What a row of a cut range is: a whole dialogue, the piece before the range's first empty line, the piece after its
#: last one, or a range without empty lines.
WHOLE, HEAD, TAIL, THROUGH = 0, 1, 2, 3


def _range_scan(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    """(file, part, start, value): records in file order within each byte range (part, start).  The part files of a
    `split=<name>` folder are one logical file, in the order of their names."""
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, r"^(.*/split=[^/]+)/[^/]+$", 1)
    return spark.read.option("lineSep", separator).text(paths).select(
        F.when(folder != "", folder).otherwise(path).alias("file"), path.alias("part"),
        F.col("_metadata.file_block_start").alias("start"), "value")


def _cut_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of ranges, in order -> (file, part, start, kind, lines)."""
    names = ["file", "part", "start", "kind", "lines"]
    key, open_, seen_blank = None, [], False

    def rows(kinds: list[int], lists: pa.Array) -> pa.RecordBatch:
        same = [pa.array([k] * len(lists), t) for k, t in zip(key, (pa.string(), pa.string(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*same, pa.array(kinds, pa.int32()), lists], names)

    def piece(kind: int) -> pa.RecordBatch:
        values = pa.concat_arrays(open_) if open_ else pa.array([], pa.string())
        return rows([kind], pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))

    for b in batches:
        if not b.num_rows:
            continue
        file, part, start, value = b.columns
        code, at = part.dictionary_encode().indices.to_numpy(), start.to_numpy()
        edges = np.flatnonzero((code[1:] != code[:-1]) | (at[1:] != at[:-1])) + 1
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(at)]):
            here = (file[i].as_py(), part[i].as_py(), int(at[i]))
            if here != key:
                if key is not None:
                    yield piece(TAIL if seen_blank else THROUGH)
                key, open_, seen_blank = here, [], False
            lines = value.slice(i, j - i)
            blank = np.flatnonzero(pc.equal(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False))
            if not len(blank):
                open_.append(lines)
                continue
            open_.append(lines.slice(0, int(blank[0])))
            yield piece(WHOLE if seen_blank else HEAD)
            seen_blank = True
            sizes = np.diff(blank) - 1
            inner = np.ones(len(lines), bool)
            inner[blank] = inner[:blank[0]] = inner[blank[-1]:] = False
            sizes = sizes[sizes > 0]
            if len(sizes):
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield rows([WHOLE] * len(sizes), pa.ListArray.from_arrays(pa.array(offsets), lines.filter(pa.array(inner))))
            open_ = [lines.slice(int(blank[-1]) + 1)]
    if key is not None:
        yield piece(TAIL if seen_blank else THROUGH)


def _blank(line: Column) -> Column:
    """White space only (most lines begin with a digit, which is told without the pattern)."""
    return ~F.substring(line, 1, 1).between("0", "9") & line.rlike(r"(?U)^\s*$")


def read_dialogue_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A10: (file, dialogue_no, lines): the lines of each dialogue of dialogue files, white-space-only lines left
    out, dialogues without content dropped, numbered from 1.  Lines end at `\\n` only, so a `\\r` before it
    stays in the text (and a line of `\\r` alone does not end a dialogue).

    The cut ranges are stored once: their counts and their rows are both read from that table.
    """
    cut = _range_scan(spark, paths, "\n").mapInArrow(_cut_ranges, "file string, part string, start long, kind int, lines array<string>") \
        .withColumn("lines", F.filter("lines", lambda x: ~_blank(x)))
    path = scratch_path(spark, "dialogue-ranges")
    cut.where((F.col("kind") != WHOLE) | (F.size("lines") > 0)).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    place = ["file", "part", "start"]
    whole = rows.where(F.col("kind") == WHOLE)
    # a dialogue over a range's end: the piece after the last empty line, ranges without any, the next head
    in_order = Window.partitionBy("file").orderBy("part", "start", "kind")
    pieces = rows.where(F.col("kind") != WHOLE).withColumn("_run", F.sum((F.col("kind") == TAIL).cast("int")).over(in_order))
    joined = pieces.groupBy("file", "_run").agg(
        F.min(F.when(F.col("kind") == TAIL, F.struct("part", "start"))).alias("at"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "start", "kind", "lines"))), lambda p: p["lines"])).alias("lines"))
    joined = joined.where(F.size("lines") > 0).select("file", F.col("at.part").alias("part"), F.col("at.start").alias("start"), "lines")
    # dialogues that start in a range: the whole ones, then the one after its last empty line; the run before a file's
    # first empty line starts at no range (null) and comes first
    counts = whole.groupBy(*place).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_whole"), F.lit(0).alias("_last")).unionByName(
        joined.select(*place, F.lit(None).cast("long").alias("_first"), F.lit(0).cast("long").alias("_whole"), F.lit(1).alias("_last")))
    counts = counts.groupBy(*place).agg(F.min("_first").alias("_first"), F.sum("_whole").alias("_whole"), F.max("_last").alias("_last"))
    before = Window.partitionBy("file").orderBy(F.asc_nulls_first("part"), "start").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum(F.col("_whole") + F.col("_last")).over(before), F.lit(0)))
    # one small row per range: stored, its size is known when the join is planned, and the dialogues need not move
    ranges = scratch_path(spark, "dialogue-counts")
    counts.write.parquet(ranges)
    counts = spark.read.schema(counts.schema).parquet(ranges)
    inner = whole.join(counts, place).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("dialogue_no"), "lines")
    same = [joined[c].eqNullSafe(counts[c]) for c in place]
    ends = joined.join(counts, same[0] & same[1] & same[2]).select(
        joined["file"], (F.col("_before") + F.col("_whole") + 1).alias("dialogue_no"), "lines")
    return inner.unionByName(ends)


def parse_dialogue_records(records: DataFrame) -> DataFrame:
    """A1: (file, dialogue_no, lines) -> turns (file, dialogue_no, dialogue_id, turn_idx, agent, text,
    malformed).

    `^\\d+\\s` is stripped; two tab fields give a user and a system turn, one field a system turn;
    three or more fields are flagged `malformed` (system turn, NULL text).
    """
    def turn(agent: str, text: Column, malformed: Column) -> Column:
        return F.struct(F.lit(agent).alias("agent"), text.alias("text"), malformed.alias("malformed"))

    def turns_of(line: Column) -> Column:
        return let(F.split(F.regexp_replace(line, r"^\d+\s", ""), "\t"), lambda f: F.when(
            F.size(f) == 2, F.array(turn("user", f[0], F.lit(False)), turn("system", f[1], F.lit(False)))).otherwise(
            F.array(turn("system", F.when(F.size(f) == 1, f[0]), F.size(f) > 2))))

    base = F.element_at(F.split("file", "/"), -1)
    named = records if "dialogue_id" in records.columns else records.withColumn(
        "dialogue_id", F.concat_ws(".", base, F.col("dialogue_no").cast("string")))
    kept = [c for c in named.columns if c != "lines"]
    ex = named.select(*kept, F.posexplode(F.flatten(F.transform("lines", turns_of))).alias("turn_idx", "t"))
    return ex.select(*kept, "turn_idx", "t.agent", "t.text", "t.malformed")


def read_dialogues(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A1/A2: read dialogue files into turns; `split` from the file name (`…-<split>.txt`)."""
    folder = F.regexp_extract("file", r"/split=([^/]+)$", 1)
    records = read_dialogue_records(spark, paths).withColumn("split", F.when(folder != "", folder).otherwise(
        F.regexp_extract("file", r"-(trn|dev|tst-OOV|tst)\.txt", 1)))
    base = F.when(folder != "", F.col("split")).otherwise(F.element_at(F.split("file", "/"), -1))
    return parse_dialogue_records(records.withColumn("dialogue_id", F.concat_ws(".", base, F.col("dialogue_no").cast("string"))))


def read_split_dialogues(spark: SparkSession, root: str, splits: list[str] | None = None) -> DataFrame:
    """A2: the turns of every split folder `root/split=<name>`; a missing split is an error."""
    return read_dialogues(spark, [f"{root.rstrip('/')}/split={s}" for s in splits or SPLIT_ORDER])


def read_dstc6(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A4: dialogues of JSON files (one object per line, or an array per file with `multi_line`)."""
    schema = "dialogue_idx bigint, utterances array<string>, answer struct<utterance:string>"
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def dstc6_turns(dialogues: DataFrame) -> DataFrame:
    """A4: DSTC6 dialogues (utterances array, answer.utterance) -> paired `usr<TAB>sys` rows.

    Keeps dialogues whose answer starts with `api_call`, appends the answer, pairs items
    (0,1), (2,3), …; dialogues with an odd count are in `dstc6_rejects` instead.
    """
    k = _dstc6_items(dialogues)
    n = F.size("_it")
    pairs = F.transform(F.sequence(F.lit(0), (n / 2).cast("int") - 1), lambda j: F.struct(
        (j + 1).alias("line_no"), F.col("_it")[2 * j].alias("user"), F.col("_it")[2 * j + 1].alias("system")))
    return k.where(n % 2 == 0).select("dialogue_idx", F.explode(pairs).alias("p")).select(
        "dialogue_idx", "p.line_no", "p.user", "p.system",
        F.format_string("%d %s\t%s", F.col("p.line_no"), F.col("p.user"), F.col("p.system")).alias("line"))


def dstc6_rejects(dialogues: DataFrame) -> DataFrame:
    """Dialogues that end in an api call but cannot be paired: (dialogue_idx, n_items)."""
    k = _dstc6_items(dialogues)
    return k.where(F.size("_it") % 2 == 1).select("dialogue_idx", F.size("_it").alias("n_items"))


def _dstc6_items(dialogues: DataFrame) -> DataFrame:
    keep = dialogues.where(F.col("answer.utterance").startswith("api_call"))
    return keep.withColumn("_it", F.concat("utterances", F.array(F.col("answer.utterance"))))


def parse_candidates(lines: DataFrame) -> DataFrame:
    """A5: candidate answers: strip, drop the first space-delimited field."""
    return lines.select(F.element_at(F.split(F.trim("value"), " ", 2), 2).alias("text"))


def read_parallel_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The two-column parallel CSV with header, as (augmented, original).  Texts that hold line ends need
    `multi_line` (a file is then read by one task)."""
    raw = spark.read.option("sep", ";").option("escape", '"').option("header", True).option("multiLine", multi_line).csv(path)
    return raw.select(F.col(raw.columns[0]).alias("augmented"), F.col(raw.columns[1]).alias("original"))


def read_pair_files(spark: SparkSession, path: str) -> DataFrame:
    """Reads what B5 wrote: (part, line, encoder, decoder), aligned by part and line."""
    def side(name: str) -> DataFrame:
        lines = spark.read.option("lineSep", "\n").text(f"{path}/{name}").select(
            "part", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"),
            F.col("value").alias(name))
        w = Window.partitionBy("part").orderBy("start", "id")
        return lines.select("part", F.row_number().over(w).alias("line"), name)

    return side("encoder").join(side("decoder"), ["part", "line"], "full")


def read_dataset_files(spark: SparkSession, path: str, names: list[str], dataset: str) -> DataFrame:
    """What `write_dataset_files` wrote: (<dataset>, part, line, encoder, decoder)."""
    from functools import reduce

    read = [read_pair_files(spark, f"{path}/{n}").select(F.lit(n).alias(dataset), F.col("part").alias("file_part"), "line", "encoder", "decoder")
            for n in names]
    return reduce(lambda a, b: a.unionByName(b), read)


def read_permutation(spark: SparkSession, path: str, separator: str = ";") -> DataFrame:
    """A permutation written as one line of integers -> (rank, dialogue_ord).

    The separator of the numbers (one character) is the scan's record separator, so that tasks read byte ranges of
    the one long line; a number cut by a range's end belongs to the range it starts in.  The numbers of a
    range have consecutive ids, and prefix sums over the ranges give the positions.  Part files
    of a folder are one line, in the order of their names.
    """
    number = F.trim(F.regexp_replace("value", "[\r\n]", ""))
    numbers = _range_scan(spark, path, separator).where(number != "").select(
        "part", "start", number.cast("bigint").alias("dialogue_ord")).withColumn("_id", F.monotonically_increasing_id())
    stored = scratch_path(spark, "permutation-numbers")
    numbers.write.parquet(stored)
    numbers = spark.read.parquet(stored)
    ranges = numbers.groupBy("part", "start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("part", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return numbers.join(ranges, ["part", "start"]).select((F.col("_before") + F.col("_id") - F.col("_first")).alias("rank"), "dialogue_ord")


def read_dialogue_files(spark: SparkSession, root: str) -> DataFrame:
    """A3: a folder of files, one per dialogue -> (ordinal, split, name, content).

    Files are named `…<split>.txt.<n>` (or lie in a folder `name=<that>`); they are ordered by the splits' corpus
    order and the integer after the last dot, and counted from 0.  Names of no split, or without an
    integer, are left out.  Positions come from the listing alone; small files are packed into tasks.
    """
    path = F.col("path")
    folder = F.regexp_extract(path, r"/name=([^/]+)/[^/]+$", 1)
    name = F.when(folder != "", folder).otherwise(F.element_at(F.split(path, "/"), -1))
    rank = split_rank(F.lit(None))
    for s in reversed(SPLIT_ORDER):
        rank = F.when(F.contains(name, F.lit(f"{s}.txt")), split_rank(F.lit(s))).otherwise(rank)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")  # no content is read
    names = listed.select("path", name.alias("name"), rank.alias("_rank"))
    number = F.element_at(F.split("name", r"\."), -1).try_cast("bigint")
    names = names.select("path", "name", "_rank", number.alias("_number")).where((F.col("_rank") < len(SPLIT_ORDER)) & F.col("_number").isNotNull())
    places = ordinal_within(names, [], ["_rank", "_number", "name"], "ordinal")
    split = F.element_at(F.array(*map(F.lit, SPLIT_ORDER)), F.col("_rank") + 1)
    content = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\n\z", "").alias("content"))
    return content.join(places, "path").select("ordinal", split.alias("split"), "name", "content")
