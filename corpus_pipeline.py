"""Training-data pipeline over `documents`: toxicity filter, fuzzy line dedup, SimHash near-dedup,
exact substring dedup, packing.

Each stage works on all that its predecessor kept and its decisions take effect: toxic documents
and near-duplicates go, repeated lines and passages are cut out of the texts (a document whose text
is used up stays, empty, until the near-dedup stage, where empty documents are one group), and the
last stage returns the packed pieces.  All stages but the last return the columns of `documents`;
`n_chars` follows the text.  A null text counts as empty in every stage and stays null until it is
packed.  Rows with a null id are scored and packed, but never stand for or lose to another row.  Rows that
repeat an id are one document for line and substring dedup; of those in one near-duplicate group one
row stays.  An empty table of documents gives no rows; extra columns go along to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import read_table, stored
from parlance.llm.lines import drop_similar_lines
from parlance.llm.packing import packing_digests
from parlance.llm.simhash import drop_simhash_duplicates
from parlance.llm.substrings import drop_repeated_substrings
from parlance.llm.toxicity import drop_toxic


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind))
                           .otherwise(F.col("n_chars")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(drop_similar_lines(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_simhash_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(drop_repeated_substrings(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: SQL cannot express the classifier, the union-find or the tokenizer; tests use brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
