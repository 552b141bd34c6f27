"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time, the words its source has handed out so far divided by
the source's target. All copies are range-sorted by it, and taken until the total budget is spent: sums of
ranges tell in which one that is, and only there are running sums made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
ROWS_A_BIN = 4096
ROWS_A_RANGE = 16384
MOST_RANGES = 20_000


def targets(sizes: list[tuple], weights=WEIGHTS, share: float = 1.0, repeats: int = REPEATS) -> dict:
    """Target of each source from (source, size): weights repeat over the sources by code point, null last.

    A target stops at ``repeats`` times its source's size; the excess is shared again by weight among the
    others until none is above. Sources without words get 0.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, out = dict(order), dict.fromkeys(dict(order), 0.0)
    left, free = share * sum(size.values()), list(size)
    while free:
        whole = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / whole > repeats * size[s]]
        if not full:
            for s in free:
                out[s] = left * weight[s] / whole
            break
        for s in full:
            out[s] = float(repeats * size[s])
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in full]
    return out


def _lookup(pairs: dict, key: Column) -> Column:
    out = F.lit(None)
    known = [x for k, v in pairs.items() if k is not None for x in (F.lit(k), F.lit(v))]
    if known:
        out = F.try_element_at(F.create_map(*known), key)
    return F.when(key.isNull(), F.lit(pairs.get(None))).otherwise(out)


def _running(rows: DataFrame, group: list[str], order: list[str], size: str, n_bins: int, key: Column) -> DataFrame:
    """Adds ``cum``, the running sum of ``size`` over ``group`` by ``order``; ``key`` (0 to 1) rises with the order.

    Rows are cut into bins of the key, so that a group of any size spreads over many tasks: sums of bins
    are added up first (by the same means while there are many), then rows within a bin.
    """
    rows = rows.withColumn("bin", F.least(F.floor(key * n_bins), F.lit(n_bins - 1)).cast("int"))
    bins = rows.groupBy(*group, "bin").agg(F.sum(size).alias("bin_size"))
    if n_bins > ROWS_A_BIN:
        bins = bins.withColumnRenamed("bin", "part")
        bins = _running(bins, group, ["part"], "bin_size", -(-n_bins // ROWS_A_BIN), F.col("part") / F.lit(float(n_bins)))
        bins = bins.select(*group, F.col("part").alias("bin"), (F.col("cum") - F.col("bin_size")).alias("before"))
    else:
        over = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.select(*group, "bin", (F.sum("bin_size").over(over) - F.col("bin_size")).alias("before"))
    inner = Window.partitionBy(*group, "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("within", F.sum(size).over(inner)).join(bins, [*group, "bin"])
    return out.withColumn("cum", F.col("before") + F.col("within")).drop("before", "within", "bin")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, repeats: int = REPEATS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken (words that the mix takes, repeats counted).

    Size: words of the text, 0 for null. Copies are shuffled within their source and round of repetition by
    MD5 of id, round and seed, ties by id, so reruns agree. Null sources are one source, the last. Texts
    without words are never taken; a source without words has target 0. Rows that repeat an id count as
    documents of their own; to tell them apart, name a column without repeats or nulls as ``key_col``, which
    comes first in the result. An empty table gives no rows. Other columns are ignored. One row a source
    reaches the driver.
    """
    key = [F.col(key_col).alias("row")] if key_col else []
    rows = docs.select(*key, F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = rows if key_col else rows.withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "sizes")
    key = [F.col("row").alias(key_col)] if key_col else []
    sums = [(r["source"], r["n"], r["k"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("k")).collect()]
    size = {s: n for s, n, _ in sums}
    goal = targets([(s, n) for s, n, _ in sums], weights, share, repeats)
    total, budget = sum(k for _, _, k in sums), share * sum(size.values())
    n_bins = max(1, -(-total // ROWS_A_BIN))
    rounds = {s: min(repeats, int(goal[s] / size[s]) + 1) if size[s] else 0 for s in size}
    src = F.col("source")
    if not sums:
        return rows.select(*key, F.col("id").alias(id_col), "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    copies = rows.filter("size > 0").withColumn("round", F.explode(F.sequence(F.lit(1), _lookup(rounds, src))))
    copies = copies.withColumn("shuffle", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("round"), F.lit(seed))))
    spread = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    copies = _by_source(copies, n_bins, spread)
    copies = copies.withColumn("finish", ((F.col("round") - 1) * _lookup(size, src) + F.col("cum")).cast("double") / _lookup(goal, src))
    won = _truncated(copies.select("row", "id", "source", "size", "round", "finish"), sum(rounds[x] * k for x, _, k in sums), budget)
    taken = won.groupBy("row").agg(F.sum("size").alias("taken"))
    return rows.join(taken, "row", "left").select(
        *key, F.col("id").alias(id_col), "size", _lookup(size, src).cast("long").alias("source_size"),
        _lookup(goal, src).cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


def _by_source(copies: DataFrame, n_bins: int, spread: Column) -> DataFrame:
    # a null source joins with nothing, so sources are grouped by a key that is never null
    keyed = copies.withColumn("key", F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))))
    return _running(keyed, ["key", "round"], ["shuffle", "id", "row"], "size", n_bins, spread).drop("key")


def _truncated(copies: DataFrame, total: int, budget: float) -> DataFrame:
    """The first of all copies by finish time whose sizes add up to the budget at most.

    Copies are dealt by ranges of the whole order, which no two share, so that no value can fill a range
    alone. A row a range reaches the driver.
    """
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("round"), F.col("id"), F.col("row")]
    n = max(1, min(MOST_RANGES, -(-total // ROWS_A_RANGE)))
    ranged = written(copies.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranged")
    before, last = 0, None
    for r in sorted(ranged.groupBy("range").agg(F.sum("size").alias("n")).collect()):
        if before + r["n"] > budget:
            last = r["range"]
            break
        before += r["n"]
    if last is None:
        return ranged.select("row", "size")
    run = F.sum("size").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    edge = ranged.filter(F.col("range") == last).withColumn("run", run + before).filter(F.col("run") <= budget)
    return ranged.filter(F.col("range") < last).select("row", "size").unionByName(edge.select("row", "size"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size / w AS ratio, sum(source_size) OVER ()::DOUBLE AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
         sum(w) OVER (ORDER BY 3 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS whole
  FROM s),
f AS (
  SELECT *, (total - capped) * w / whole > 3 * source_size AS is_full FROM r),
g AS (
  SELECT (total - capped) AS rest, whole FROM f WHERE NOT is_full ORDER BY ratio, source LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE g.rest * w / g.whole END AS target
  FROM f LEFT JOIN g ON true),
c AS (
  SELECT doc_id, d.source, size, target, round,
         ((round - 1) * source_size + sum(size) OVER (PARTITION BY d.source, round ORDER BY md5(concat_ws(':', doc_id, round, 0)), doc_id
            ROWS UNBOUNDED PRECEDING))::DOUBLE / target AS finish
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source,
       unnest(range(1, least(3, floor(target / source_size)::BIGINT + 1) + 1)) AS u(round)
  WHERE size > 0),
m AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, round, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
k AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM m WHERE run <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON d.doc_id = k.doc_id
"""
