"""Shared working folder, size-checked joins and connected components used by the operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_DIR = "/tmp/checkpoints"
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local default in a single process."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir")
    if not path and not re.match(r"local(\[|$)", conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or DEFAULT_DIR


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of text over all rows, by which the number of hash parts is chosen."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def crc_mod(id_col: str | Column, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % n


def semi_by_id(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``ids``: broadcast behind a count of the ids, a shuffled join beyond it."""
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return rows.join(ids, key, "left_semi")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, hot_share: int = 1000) -> DataFrame:
    """Inner join of rows with their group's row, where ``groups[size]`` counts the rows of each group.

    A group above 1/``hot_share`` of all rows would fill one task. There are fewer than ``hot_share`` such
    groups, whatever the input, so they are broadcast; the rest meet in a shuffled join.
    """
    most = max(1, total // hot_share)
    hot, cold = groups.filter(F.col(size) > most), groups.filter(F.col(size) <= most)
    names = [F.col(f"r.{k}") for k in rows.columns] + [F.col(f"g.{c}") for c in groups.columns if c not in keys]
    on = [F.col(f"r.{k}") == F.col(f"g.{k}") for k in keys]
    near = rows.alias("r").join(F.broadcast(hot.alias("g")), on).select(*names)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return near.unionByName(rest.alias("r").join(cold.hint("merge").alias("g"), on).select(*names))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """Connected components of undirected links as (id, component): the smallest id that each id reaches.

    Alternates large-star and small-star contraction, each round written to the shared folder, until no
    link changes. Ids without links have no row. Neighbourhoods are only reduced to their minimum, so a hub
    needs no list of its links.
    """
    spark = edges.sparkSession
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")

    def mark(x: DataFrame):
        return x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    last = mark(e)
    for _ in range(max_rounds):
        if not last[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        met = e.join(low, "u")
        e = met.select("u", F.col("m").alias("v")).unionByName(met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = written(e.distinct(), "links")
        now = mark(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    ids = roots.select(F.col("u").alias("id"), "component")
    return ids.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).join(ids.select("id"), "id", "left_anti").distinct())


def bounded_sample(rows: DataFrame, label: str, id_col: str, per_class: int, seed: int = 0) -> DataFrame:
    """Up to ``per_class`` rows of each label, those with the least hash of the id: the same for any partitioning."""
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    order = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 40))
    share = F.lit(0.0)
    for value, n in sizes.items():
        # twice as many as are needed, so that a large class is cut before it is sorted
        share = F.when(F.col(label).eqNullSafe(F.lit(value)), F.lit(min(1.0, (2.0 * per_class + 50) / n))).otherwise(share)
    some = rows.withColumn("_order", order).filter(F.col("_order") < share * F.lit(float(1 << 40)))
    first = Window.partitionBy(label).orderBy("_order", id_col)
    return some.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= per_class).drop("_order", "_rank")


def within_bytes(rows: DataFrame, label: str, text: str, most: int, id_col: str = "id", seed: int = 0) -> DataFrame:
    """Of a bounded sample the rows of each label, in the order of their hash, whose texts have ``most`` bytes together; one at least."""
    order = [F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 40)), F.col(id_col)]
    over = Window.partitionBy(label).orderBy(*order)
    sizes = F.sum(F.octet_length(text)).over(over.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_sum", sizes).withColumn("_rank", F.row_number().over(over))
    return out.filter((F.col("_sum") <= most) | (F.col("_rank") == 1)).drop("_sum", "_rank")
