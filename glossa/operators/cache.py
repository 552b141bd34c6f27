"""A cache of answers by name and context, in namespaces, with encounter counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.runs import BUCKETS, FAN, RunLog

KEY = ["name", "context"]
ANSWERS = "cache_id string, name string, context string, words string, tag_time timestamp"
SEEN = "cache_id string, name string, context string, first_encounter timestamp, last_encounter timestamp, cnt bigint"


def first_answer():
    """Aggregates that keep the first answer of a key; of one time the least text."""
    return [F.min_by("words", F.struct("tag_time", "words")).alias("words"), F.min("tag_time").alias("tag_time")]


def seen():
    """Aggregates of encounters."""
    return [F.min("first_encounter").alias("first_encounter"), F.max("last_encounter").alias("last_encounter"), F.sum("cnt").alias("cnt")]


class TagCache:
    """Answers and encounters by (cache_id, name, context), each a table of compacted runs.

    Writers don't wait for each other. Answer texts are kept at their first time; a batch of encounters that
    is sent again under its writer and number counts once. Nulls are keys too.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.path = spark, path.rstrip("/")
        keys = ["cache_id", *KEY]
        self.answer_log = RunLog(spark, f"{self.path}/answers", keys, first_answer(), ANSWERS, buckets, fan)
        self.encounter_log = RunLog(spark, f"{self.path}/encounters", keys, seen(), SEEN, buckets, fan)

    def add(self, answers: DataFrame, writer: str | None = None, number: int | None = None) -> None:
        """Append (cache_id, name, context, words), stamped with the time of the call."""
        self.answer_log.append(answers.select("cache_id", *KEY, "words", F.current_timestamp().alias("tag_time")), writer, number)

    def encounter(self, requests: DataFrame, ts: str, writer: str | None = None, number: int | None = None) -> bool:
        """Count requests (cache_id, name, context, ts); False if the batch has been counted already."""
        at = F.col(ts).cast("timestamp")
        rows = requests.select("cache_id", *KEY, at.alias("first_encounter"), at.alias("last_encounter"), F.lit(1).cast("bigint").alias("cnt"))
        return self.encounter_log.append(rows, writer, number)

    def answers(self) -> DataFrame:
        """The first answer of each (cache_id, name, context)."""
        return self.answer_log.state().select("cache_id", *KEY, "words", "tag_time")

    def encounters(self) -> DataFrame:
        return self.encounter_log.state()

    def find(self, cache_id: str | None, name: str | None, context: str | None) -> DataFrame:
        """One row or none: the answer to a request, from one bucket of each run."""
        return self.answer_log.find(cache_id, name, context)

    def lookup(self, requests: DataFrame) -> DataFrame:
        """``requests`` with words and tag_time of their answer, null where the cache has none. Null keys are keys too."""
        asked, known = requests.alias("r"), self.answers().alias("a")
        on = [F.col(f"r.{k}").eqNullSafe(F.col(f"a.{k}")) for k in ("cache_id", *KEY)]
        return asked.join(known, on, "left").select("r.*", "a.words", "a.tag_time")


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, as a lookup of one row at a time would give it."""
    over = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(over)).filter("_r = 1").drop("_r")
