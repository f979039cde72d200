"""The per-turn augmentation gives the same rows on a stream as in batch."""

from pyspark.sql import functions as F

from parlance.operators.augment import augment_turns
from parlance.operators.vocab import SlotVocabulary, slot_values
from parlance.plans import catalog as C
from parlance.sources.config import ActionConfig
from parlance.sources.corpus import corpus_path, load_corpus
from parlance.streaming.augment_stream import augment_stream, read_turn_stream, write_augmented

SF_SMALL = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    cfg = ActionConfig.preset("default")
    vocab = SlotVocabulary.build(slot_values(load_corpus(spark, SF_SMALL)))
    stream = augment_stream(read_turn_stream(spark, corpus_path(spark, SF_SMALL)), cfg, vocab)
    q = (stream.select("split", "dialogue_idx", "turn_idx", "text").writeStream.format("memory")
         .queryName("aug_stream").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM aug_stream").collect())
    batch = C.QUERIES["augment_corpus"](spark, SF_SMALL).select("split", "dialogue_idx", "turn_idx", "text")
    assert got == sorted(tuple(r) for r in batch.collect())


def test_stored_vocabulary_of_fifty_thousand(spark, tmp_path):
    """The vocabulary stays a table: micro-batches give the batch job's rows, and a batch run twice changes nothing."""
    turns = spark.range(25_000).select(
        F.lit("trn").alias("split"), F.col("id").alias("dialogue_idx"), F.lit("d").alias("dialogue_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("turn_idx"))
    city, dish = F.concat(F.lit("city"), "dialogue_idx"), F.concat(F.lit("dish"), "dialogue_idx")
    turns = turns.select("*", F.when(F.col("turn_idx") == 0, "user").otherwise("system").alias("agent"),
                         F.when(F.col("turn_idx") == 0, F.concat_ws(" ", F.lit("a table in"), city, F.lit("with"), dish, F.lit("food")))
                         .otherwise(F.concat_ws(" ", F.lit("api_call"), city, dish)).alias("text"))
    vocab = SlotVocabulary.build(slot_values(turns))
    assert not vocab.inlined and vocab.words.count() == 50_000
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    turns.repartition(6).write.partitionBy("split").parquet(source)
    cfg = ActionConfig.preset("default")
    stream = read_turn_stream(spark, source, max_files_per_trigger=2)
    q = write_augmented(stream, cfg, vocab, out, str(tmp_path / "ckpt"))
    q.processAllAvailable()
    q.stop()
    cols = ["dialogue_idx", "turn_idx", "text", "actions"]
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == 3
    want = augment_turns(spark.read.parquet(source), cfg, vocab).select(*cols)
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.collect()))
    assert got.where("size(actions) > 0").count() > 5000
