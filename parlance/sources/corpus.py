"""The `turns` corpus the operators work on.

`fixture_turns` derives a slot-filling dialogue corpus from the TPC-H-like `orders`,
`customer` and `nation` tables: eight turns per order, four splits, api-call turns
at the end.  `load_corpus` writes it once per session as a Parquet table partitioned
by `split` (under the shared checkpoint folder) and reads it back, so that every
query starts from a stored turns table, as a production corpus would.  The table is small for the
work that is done on its rows, so it is written in many even files and read by several tasks a core: one
task too large would hold up a whole query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import more_scan_tasks, scratch_path

TURN_COLUMNS = ["split", "dialogue_idx", "dialogue_id", "turn_idx", "agent", "text"]

#: Files of the stored corpus hold more dialogues than the first and, but for the sampler's error, fewer than the second
#: number: a task that reads one takes as long in a large corpus as in a small one.
DIALOGUES_PER_FILE = 2_000
MOST_DIALOGUES_PER_FILE = 50_000

# Split names in corpus order.
SPLIT_ORDER = ["trn", "dev", "tst", "tst-OOV"]


def split_rank(col: Column) -> Column:
    """Position of a split name in the fixed corpus order (unknown names last)."""
    expr = F.lit(len(SPLIT_ORDER))
    for i, name in reversed(list(enumerate(SPLIT_ORDER))):
        expr = F.when(col == name, F.lit(i)).otherwise(expr)
    return expr


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the `fx` turns table from orders ⋈ customer ⋈ nation (not materialized)."""
    return _turns_of(_fixture_dialogues(spark, sf_dir))


def _fixture_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per dialogue: its key, its split and its slot values."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # nation is the fixed 25-row TPC-H dimension: broadcasting it is size-bounded.
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("o_orderkey")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("dialogue_idx"),
            F.lower("c_mktsegment").alias("cuisine"),
            F.lower("n_name").alias("loc"),
            F.when(key % 4 == 0, "two").when(key % 4 == 1, "four").when(key % 4 == 2, "six")
            .otherwise("eight").alias("party"),
            F.when(F.col("o_totalprice") < 150000, "cheap")
            .when(F.col("o_totalprice") < 350000, "moderate")
            .otherwise("expensive").alias("price"),
            F.when(F.col("n_nationkey") >= 20, "tst-OOV").when(key % 10 < 7, "trn")
            .when(key % 10 < 8, "dev").otherwise("tst").alias("split"),
        )
    )


def _turns_of(d: DataFrame) -> DataFrame:
    # eight turns per dialogue: a narrow generator instead of a join with a constant table
    t = d.withColumn("turn_idx", F.explode(F.sequence(F.lit(0), F.lit(7))))
    i, even = F.col("dialogue_idx"), F.col("dialogue_idx") % 2 == 0
    ti = F.col("turn_idx")
    text = (
        F.when(ti == 0, F.when(i % 3 == 0, "hello").when(i % 3 == 1, "hi").otherwise("good morning"))
        .when(ti == 1, F.lit("hello what can i help you with today"))
        .when(ti == 2, F.when(even, F.concat(
            F.lit("can you book a table in "), "loc", F.lit(" with "), "cuisine",
            F.lit(" cuisine for "), "party", F.lit(" people in a "), "price", F.lit(" price range please")))
            .otherwise(F.concat(F.lit("may i have a table for "), "party", F.lit(" people with "),
                                "cuisine", F.lit(" food in "), "loc")))
        .when(ti == 3, F.when(even, "i am on it").otherwise("which price range are looking for"))
        .when(ti == 4, F.when(even, F.lit("<SILENCE>")).otherwise(
            F.concat(F.lit("in a "), "price", F.lit(" price range please"))))
        .when(ti == 5, F.lit("ok let me look into some options for you"))
        .when(ti == 6, F.lit("<SILENCE>"))
        .otherwise(F.concat_ws(" ", F.lit("api_call"), "cuisine", "loc", "party", "price"))
    )
    return t.select(
        "split",
        "dialogue_idx",
        F.concat_ws(".", "split", F.col("dialogue_idx").cast("string")).alias("dialogue_id"),
        "turn_idx",
        F.when(ti % 2 == 0, "user").otherwise("system").alias("agent"),
        text.alias("text"),
    )


_MATERIALIZED: dict[tuple[str, str], str] = {}
_FILES: dict[str, int] = {}


def load_corpus(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """The fixture corpus as a stored table: partitioned by split, sorted by dialogue and turn."""
    if not materialize:
        return fixture_turns(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    path = _MATERIALIZED.get(key)
    if path is None:
        path = scratch_path(spark, "turns")
        # range partitioning on (split, dialogue) spreads a large split over many tasks; dialogues are dealt, an eighth
        # of the rows, and their turns follow in order
        _FILES[path] = _n_files(spark, sf_dir)
        dialogues = _fixture_dialogues(spark, sf_dir).repartitionByRange(_FILES[path], "split", "dialogue_idx")
        (
            _turns_of(dialogues.sortWithinPartitions("split", "dialogue_idx"))
            .write.mode("overwrite")
            .partitionBy("split")
            .parquet(path)
        )
        _MATERIALIZED[key] = path
    more_scan_tasks(spark, at_least=_FILES[path])
    df = spark.read.parquet(path)
    return df.select(*TURN_COLUMNS)


def _n_files(spark: SparkSession, sf_dir: str) -> int:
    """Files of the stored corpus: several for each core where there are dialogues enough."""
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return files_of(table(spark, sf_dir, "orders").count(), most)


def files_of(dialogues: int, most: int) -> int:
    """`most` files, fewer where they would be tiny and more where they would be large."""
    return max(1, min(most, dialogues // DIALOGUES_PER_FILE), -(-dialogues // MOST_DIALOGUES_PER_FILE))


def corpus_path(spark: SparkSession, sf_dir: str) -> str:
    """Where `load_corpus` stored the turns table of `sf_dir` (materializing it if needed)."""
    load_corpus(spark, sf_dir)
    return _MATERIALIZED[(spark.sparkContext.applicationId, sf_dir.rstrip("/"))]


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations(conv_id, turn, role, text)` in the canonical turn layout."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.lit("conv").alias("split"),
        F.col("conv_id").cast("bigint").alias("dialogue_idx"),
        F.concat(F.lit("conv."), F.col("conv_id").cast("string")).alias("dialogue_id"),
        F.col("turn").cast("int").alias("turn_idx"),
        F.col("role").alias("agent"),
        "text",
    )
