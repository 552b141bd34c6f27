"""Encounter state over a stream, keyed by (name, context) or other columns, and streams of requests."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cache import KEY, TagCache, seen
from ..operators.core import encounters
from ..sources.runs import RunLog
from ..sources.working import exists, scratch


def _log(spark: SparkSession, path: str, keys: list[str]) -> RunLog:
    return RunLog(spark, path, keys, seen())


def encounter_stream(events: DataFrame, keys: list[str], ts: str, path: str, checkpoint: str):
    """Starts the query that keeps first, last and count of each key under ``path``; runs what is available and ends.

    Each micro-batch is reduced to a row a key and appended as a run under its number, so that a batch that is
    run again after a failure counts once; runs are merged by levels. As first, last and count of parts add up to
    those of the whole, there is no state to keep between batches, and late events count whenever they come,
    without a watermark. Streams of other checkpoints may write to the same path.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = encounters(batch.withColumn(ts, F.col(ts).cast("timestamp")), keys, ts)
        _log(batch.sparkSession, path, keys).append(rows, checkpoint, number)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def encounter_state(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(keys, first_encounter, last_encounter, cnt) of what ``encounter_stream`` has written so far."""
    return _log(spark, path, keys).state()


def answer_batch(cache: TagCache, requests: DataFrame, ts: str, tag, writer: str, number: int) -> DataFrame:
    """``requests`` (cache_id, name, context, ts) with ``words``, ``hit`` and, of a hit, what had been seen before this batch.

    Keys that the cache lacks are tagged once each, by ``tag``: a Column of text from the columns name and context,
    and added. All requests of the batch then count as encounters. The same batch under the same number answers
    again as it did: what it found is read from a table of its own, written before the cache is changed.
    """
    keys = ["cache_id", *KEY]
    spark = requests.sparkSession
    home = f"{cache.path}/batches/{writer}/{number}"
    if not exists(spark, f"{home}/_SUCCESS"):
        both = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
        asked = requests.select(*keys).distinct().alias("r")
        known = asked.join(cache.answers().alias("a"), both("r", "a"), "left").select("r.*", F.col("a.words").alias("known"), F.col("a.tag_time").isNotNull().alias("hit"))
        before = known.alias("r").join(cache.encounters().alias("e"), both("r", "e"), "left").select("r.*", "e.first_encounter", "e.last_encounter", "e.cnt")
        out = before.withColumn("words", F.when(F.col("hit"), F.col("known")).otherwise(tag)).drop("known")
        for c in ("first_encounter", "last_encounter", "cnt"):
            out = out.withColumn(c, F.when(F.col("hit"), F.col(c)))
        out.write.mode("overwrite").parquet(home)
    found = spark.read.parquet(home)
    cache.add(found.filter("NOT hit").select(*keys, "words"), writer, number)
    cache.encounter(requests, ts, writer, number)
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return requests.alias("r").join(found.alias("f"), on).select("r.*", "f.words", "f.hit", "f.first_encounter", "f.last_encounter", "f.cnt")


def answer_stream(requests: DataFrame, cache_path: str, ts: str, tag, path: str, checkpoint: str):
    """Answers a stream of (cache_id, name, context, ts) from the cache at ``cache_path`` or by ``tag``, each request once.

    Answers of a micro-batch are a folder of their own under ``path``, which a batch that is run again replaces by
    the same. ``answers`` reads them.
    """
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        out = answer_batch(TagCache(batch.sparkSession, cache_path), batch, ts, tag, writer, number)
        out.write.mode("overwrite").parquet(f"{path}/writer={writer}/batch={number}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers(spark: SparkSession, path: str) -> DataFrame:
    """What ``answer_stream`` has answered so far, with writer and batch."""
    return spark.read.parquet(path)


def tagged_stream(requests: DataFrame, path: str, checkpoint: str):
    """Tags a stream of (name, context, cache_id) and appends the answers, partitioned by cache_id."""
    from ..functions.words import split_identifier
    from ..operators.core import tag_words

    words = split_identifier(F.col("name"))
    out = requests.withColumn("words", words).withColumn("tags", tag_words(F.col("words")))
    return out.writeStream.partitionBy("cache_id").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def drain(spark: SparkSession, source_dir: str, schema, keys: list[str], ts: str) -> DataFrame:
    home = scratch(spark, "encounters")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(source_dir)
    encounter_stream(source, keys, ts, f"{home}/state", f"{home}/log").awaitTermination()
    return encounter_state(spark, f"{home}/state", keys)
