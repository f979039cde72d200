"""Structured Streaming: augment and tag turns as they arrive.

The per-turn operators are narrow expressions, so with an inlined vocabulary they run unchanged on a
streaming DataFrame (`augment_stream`).  A larger vocabulary is a stored table: `write_augmented` joins
the tokens of each micro-batch with it, as a batch job does, for a vocabulary of any size.
Multi-turn corrections need the whole dialogue and are rejected here (they need a per-dialogue window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.augment import augment_turns
from ..operators.vocab import SlotVocabulary
from ..sources.config import ActionConfig
from ..sources.corpus import TURN_COLUMNS

TURN_SCHEMA = ("split string, dialogue_idx bigint, dialogue_id string, turn_idx int, agent string, "
               "text string")


def read_turn_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 64) -> DataFrame:
    """A stream of turns from Parquet files landing in `path` (partitioned by split)."""
    return (spark.readStream.schema(TURN_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path).select(*TURN_COLUMNS))


def write_augmented(stream: DataFrame, cfg: ActionConfig, vocab: SlotVocabulary, path: str, checkpoint: str, seed: int = 273,
                    **kw) -> StreamingQuery:
    """Augments a stream under a vocabulary of any size into Parquet files, `path/batch=<n>`.

    A micro-batch is a static set of rows, so the joined plan applies to it.  A batch that is run again
    after a failure overwrites its own folder: draws do not depend on the run, so the rows are the same.
    """
    if cfg.can_fire("multiturn_correct"):
        raise ValueError("multi-turn corrections need whole dialogues; run them in batch")

    def write(rows: DataFrame, batch: int) -> None:
        augment_turns(rows, cfg, vocab, seed=seed, **kw).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def augment_stream(stream: DataFrame, cfg: ActionConfig, vocab: SlotVocabulary, seed: int = 273,
                   **kw) -> DataFrame:
    if cfg.can_fire("multiturn_correct"):
        raise ValueError("multi-turn corrections need whole dialogues; run them in batch")
    if not vocab.inlined:
        raise ValueError("a stored vocabulary is joined by micro-batches: use write_augmented")
    return augment_turns(stream, cfg, vocab, seed=seed, **kw)
