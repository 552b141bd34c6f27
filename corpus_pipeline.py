"""A corpus pipeline: language, exact copies, near copies, mixture, tokens. Each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from glossa.llm.shared import written


def _free(name: str, docs: DataFrame) -> str:
    """A name like ``name`` that no column has."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the column that tells rows apart: doc_id, or if any is null or repeated a number for each row, written with it."""
    if docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        return docs, "doc_id"
    key = _free("_row", docs)
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _only(docs: DataFrame, kept: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows of ``docs`` that are kept. Most are, so their keys grow with the input and are never broadcast."""
    return docs.join(written(kept.select(key), "kept").hint("merge"), key, "left_semi").select(columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: their text has a letter and is not further from all languages than texts that are known.

    Learned from the lang column of all documents. Rows of any id, repeated or null, are judged by their text
    alone, and equal texts alike; null and empty texts go. Columns of any name are carried along.
    """
    return language_id.filter_known(docs, language_id.train(docs, F.lit(False)))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group with equal text but for white space: the longest, then that of the smallest doc_id.

    A null doc_id comes last. Of rows that repeat doc_id and text one stays. Null and empty texts are one group.
    """
    rows, key = _keyed(docs)
    return _only(rows, exact_dedup.dedup(rows, id_col=key, order_col="doc_id").filter("kept"), key, docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by sets of five-word shingles with a similarity of 0.8 or more: that of the smallest doc_id.

    A null doc_id comes last. Rows are documents of their own, also where they repeat a doc_id. Texts without
    words link with nothing and stay.
    """
    rows, key = _keyed(docs)
    groups = near_dedup.near_groups(rows, k=5, percent=80, id_col=key).select(F.col(key).alias("row"), "component_id")
    ids = rows.select(F.col(key).alias("row"), F.col("doc_id").alias("id"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    first = groups.join(ids, "row").groupBy("component_id").agg(F.min(order).alias("first"))
    return _only(rows, first.select(F.col("first.row").alias(key)), key, docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them, each on its own account, also where they repeat a doc_id or have none.

    Texts without words are taken 0 times.
    """
    rows, key = _keyed(docs)
    times = _free("_times", docs)
    copies = (F.col("taken") / F.col("size")).cast("int")
    taken = mixing.mix(rows.select(F.col(key).alias("row"), "doc_id", "text", "source"), key_col="row").filter("taken > 0")
    taken = taken.select(F.col("row").alias(key), F.array_repeat(F.lit(0), copies).alias(times))
    out = rows.join(taken.hint("merge"), key)
    return out.select(*docs.columns, F.explode(times)).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, with digests of the ids and of the text that they decode to. A null id stays null."""
    out = bpe.encode(docs, bpe.vocabulary())
    return out.select(
        "doc_id", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language identification", known_language),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mixing", mixed),
    ("byte-pair encoding", encoded),
]

#: The language model of the first stage and the tokens of the last can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
