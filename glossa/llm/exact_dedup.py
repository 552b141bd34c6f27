"""Exact dedup over a persistent digest index, bucketed and sorted by digest.

Texts are equal when identical after the removal of ASCII white space; null counts as the empty text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, join_groups, written

WHITE = " \t\n\x0b\x0c\r"


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE, ""), 256))


class DigestIndex:
    """A table (digest, keep_id, group_size), bucketed and sorted by digest, kept under ``path``.

    New data is reduced to one entry a digest, sort-merge anti-joined with the index and appended. As the
    table is bucketed by its join key, neither join shuffles the index. The number of buckets and the type of
    ids are written beside the data: a path that holds an index is opened with those, in any session, and
    raises if it is asked for others; so does a table's name. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, table: str | None = None, buckets: int | None = None, id_type: str | None = None):
        self.spark, self.table = spark, table or f"digest_index_{uuid.uuid4().hex}"
        known = spark.catalog.tableExists(self.table)
        if known:
            told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {self.table}").collect()}
            made = (int(told.get("Num Buckets", 0)), told["keep_id"])
        else:
            path = path or fresh_path(spark, "digest-index")
            made = self._made(path)
        asked = (buckets or made and made[0] or int(spark.conf.get("spark.sql.shuffle.partitions")), id_type or made and made[1] or "bigint")
        if made and made != asked:
            raise ValueError(f"the index has {made[0]} buckets and ids of type {made[1]}, not {asked[0]} and {asked[1]}")
        self.buckets, self.id_type = asked
        if not known:
            if not made:
                spark.createDataFrame([asked], "buckets int, id_type string").write.parquet(f"{path}/_made")
            spark.sql(
                f"CREATE TABLE {self.table} (digest BINARY, keep_id {self.id_type}, group_size BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
            )

    def _made(self, path: str) -> tuple[int, str] | None:
        """What the index at ``path`` was made with; None if there is none. Data without that note is refused."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_made")):
            return tuple(self.spark.read.parquet(f"{path}/_made").first())
        if fs.exists(at) and len(fs.listStatus(at)):
            raise ValueError(f"{path} has files, but no note of an index's buckets")
        return None

    def frame(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, entries: DataFrame) -> DataFrame:
        """Add the entries whose digest the index lacks; gives all entries back, written."""
        entries = written(entries, "digest-new")  # else the anti-join is moved below the aggregate, before rows of a digest are one
        new = entries.join(self.frame().select("digest").hint("merge"), "digest", "left_anti")
        cols = ("digest", "keep_id", "group_size")
        new.select(*cols).repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)
        return entries


def dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size (rows of the batch that made the index entry), kept, text_sha256.

    Of equal texts the one with the most code points stays, then the smallest ``order_col`` if one is named,
    then the smallest id; nulls come last. Rows that repeat id and text alike can't be told apart and are
    marked alike, unless a column without repeats is named as id. Null and empty texts are one
    group. Against a filled index, a text that it holds is dropped in favour of the id that came first. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"), F.col(order_col or id_col).alias("order"))
    rows = written(rows, "digests")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("order").isNull().alias("last"), "order", F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    entries = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")).select("digest", F.col("best.id").alias("keep_id"), "group_size")
    if index is None:
        index = DigestIndex(spark, id_type=rows.schema["id"].dataType.simpleString())
    entries = index.append(entries)
    # which digests are hot is a matter of this batch, whatever the batch that made their entry
    here = entries.select("digest", F.col("group_size").alias("rows")).join(index.frame().hint("merge"), "digest")
    found = join_groups(rows, here, ["digest"], "rows", rows.count())
    return found.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


def digest_index_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two batches, first even ids, through an index that is closed and opened again by its path."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "digest-index")
    out = []
    for i in (0, 1):
        index = DigestIndex(spark, path=path)
        out.append(written(dedup(docs.filter(F.pmod("doc_id", F.lit(2)) == i), index), "batch"))
        spark.sql(f"DROP TABLE {index.table}")  # the name only
    return out[0].unionByName(out[1])


BATCHES_SQL = r"""
WITH d AS (
  SELECT doc_id, doc_id % 2 AS batch, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
e AS (SELECT *, min(batch) OVER (PARTITION BY text_sha256) AS made FROM d)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) FILTER (batch = made) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM e
WINDOW w AS (PARTITION BY text_sha256 ORDER BY batch, n DESC, doc_id)
"""
