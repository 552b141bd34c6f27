"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, and the index is a table of every code under the value of each of its segments.
With all segments searched up to radius s, every code within distance segments * (s + 1) - 1 has been met,
since a code further off in each segment is further off in all. So a query probes the values at a growing
radius around its own segments until its kth verified distance is within that bound, and codes that it does
not meet are never compared. Probes and index rows of one bucket of values meet in one task by a shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .packing import ranges, trim
from .shared import written

SEGMENTS, BITS = 4, 16
LOW = 8  # bits of a segment's value inside a bucket; the others name the bucket
CHUNK = 8192  # index rows of a bucket that a task holds at once
FLIPS = [np.array([m for m in range(1 << LOW) if m.bit_count() == d], np.int64) for d in range(LOW + 1)]
PAIRS = 1 << 20


def codes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, code): bit i is set where component i is above 0. Vectors of other than 64 components or with nulls have none."""
    v = F.col(vec_col)
    bits = F.aggregate(F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    fit = (F.size(v) == SEGMENTS * BITS) & ~F.exists(v, lambda x: x.isNull())
    return vectors.filter(fit & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), bits.alias("code"))


def _segments(rows: DataFrame) -> DataFrame:
    """A row a segment: its number, the bucket of its value and the rest of the value, low."""
    each = F.array(*[F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned("code", s * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("value")) for s in range(SEGMENTS)])
    out = rows.select("*", F.explode(each).alias("_s"))
    return out.select(*rows.columns, "_s.segment", F.shiftright("_s.value", LOW).alias("bucket"), F.col("_s.value").bitwiseAND(F.lit((1 << LOW) - 1)).alias("low"))


def index(base: DataFrame) -> DataFrame:
    """(segment, bucket, chunk, low, row, id, code): each code under all its segments; large buckets are dealt over chunks."""
    rows = _segments(base)
    counts = rows.groupBy("segment", "bucket").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    counts = F.broadcast(written(counts, "buckets"))  # as many as there are buckets, whatever the input
    rows = rows.join(counts, ["segment", "bucket"]).withColumn("chunk", F.pmod(F.xxhash64("row"), "chunks"))
    return written(rows.select("segment", "bucket", "chunk", "low", "row", "id", "code"), "index")


def _probes(queries: DataFrame, chunks: DataFrame, radii: list[int]) -> DataFrame:
    """What queries ask of buckets at these very radii: so many bits differ in the bucket, the rest (need) must in low."""
    rows = None
    for radius in radii:
        flips = F.explode(F.filter(F.sequence(F.lit(0), F.lit((1 << (BITS - LOW)) - 1)), lambda m: F.bit_count(m).between(radius - LOW, radius)))  # noqa: B023  called at once
        some = _segments(queries).select("*", flips.alias("_m")).withColumn("need", F.lit(radius) - F.bit_count("_m"))
        rows = some if rows is None else rows.unionByName(some)
    rows = rows.withColumn("bucket", F.col("bucket").bitwiseXOR(F.col("_m")))
    rows = rows.join(F.broadcast(chunks), ["segment", "bucket"])  # buckets without a code are not asked
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    return rows.select("segment", "bucket", "chunk", F.col("need").cast("int").alias("need"), "low", "id", "code", "most")


class Bucket:
    """A chunk of a bucket's index rows by the low bits of their value."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        low, self.row, self.id, self.code = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(low, kind="stable")
        self.row, self.id, self.code = self.row[order], self.id[order], self.code[order]
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(low, minlength=1 << LOW))))

    def search(self, need: int, low: np.ndarray, code: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(probe, place, distance) of codes at this distance in the low bits that are near enough; a probe's k best."""
        values = (low[:, None] ^ FLIPS[need][None]).reshape(-1)
        start, lens = self.ends[values], self.ends[values + 1] - self.ends[values]
        probe = np.repeat(np.repeat(np.arange(len(low)), len(FLIPS[need])), lens)
        place = ranges(start, lens)
        far = np.bitwise_count(self.code[place] ^ code[probe]).astype(np.int64)
        near = far <= most[probe]
        probe, place, far = probe[near], place[near], far[near]
        order = np.lexsort((self.id[place], far, probe))
        probe, place, far = probe[order], place[order], far[order]
        first = np.searchsorted(probe, probe)
        best = np.arange(len(probe)) - first < k
        return probe[best], place[best], far[best]


def _meet(k: int):
    """Index rows (need -1) of a chunk come before the probes of it."""

    def run(batches):
        held, parts, bucket = None, [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)])
            need, low, row, own, most = (batch.column(i).to_numpy() for i in (3, 4, 5, 6, 8))
            code = batch.column(7).to_numpy().view(np.uint64)
            change = np.any(key[:, 1:] != key[:, :-1], axis=0) | (need[1:] != need[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(need)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held != (now := tuple(key[:, a].tolist())):
                    held, parts, bucket = now, [], None
                if need[a] < 0:
                    parts.append((low[a:b], row[a:b], own[a:b], code[a:b]))
                    continue
                if not parts:
                    continue
                bucket = bucket or Bucket(parts)
                for i in range(a, b, max(1, PAIRS // CHUNK)):
                    j = min(b, i + max(1, PAIRS // CHUNK))
                    probe, place, far = bucket.search(int(need[a]), low[i:j], code[i:j], most[i:j], k)
                    if len(probe):
                        cols = [own[i:j][probe], code[i:j][probe].view(np.int64), bucket.row[place], bucket.id[place], far]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "query_code", "row", "id", "distance"])
        trim()

    return run


def first_radius(n: int, k: int) -> int:
    """The least radius at which a query is expected to meet ``k`` of ``n`` codes, if they are spread evenly."""
    met = 0.0
    for radius in range(BITS + 1):
        met += SEGMENTS * math.comb(BITS, radius) * n / (1 << BITS)
        if met >= k:
            return radius
    return BITS


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` to each row of ``queries`` by Hamming distance of sign codes, ties by id.

    Columns query_id, rank (from 1), the id, distance. A query that is among the vectors meets itself. Rows
    without id or with a vector of another length or with nulls take no part; fewer than ``k`` vectors are
    all returned. Rows that repeat an id are vectors of their own; queries that repeat id and code are one,
    and with another code they are ranked apart. Other columns are ignored; empty tables give no rows.
    """
    base = written(codes(vectors, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()), "codes")
    found = index(base)
    chunks = written(found.groupBy("segment", "bucket").agg(F.max("chunk").alias("last")), "chunks")
    n = base.count()
    key = ["query_id", "query_code"]
    waiting = codes(queries, id_col, vec_col).distinct().select(F.col("id").alias("query_id"), F.col("code").alias("query_code"))
    waiting = written(waiting.withColumn("most", F.lit(SEGMENTS * BITS).cast("long")), "queries")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("distance", "id", "row"))
    index_rows = found.select("segment", "bucket", "chunk", F.lit(-1).alias("need"), "low", "row", "id", "code", F.lit(0).cast("long").alias("most"))
    best, start = None, first_radius(n, k)
    steps = [(0, start), *((a, min(a + 1, BITS)) for a in range(start + 1, BITS + 1, 2))]  # a job costs more than a radius
    for low, radius in steps:
        probes = _probes(waiting.toDF("id", "code", "most"), chunks, list(range(low, radius + 1)))
        rows = index_rows.unionByName(probes.withColumn("row", F.lit(0).cast("long")).select(index_rows.columns))
        rows = rows.repartition("segment", "bucket", "chunk").sortWithinPartitions("segment", "bucket", "chunk", "need")
        met = rows.mapInArrow(_meet(k), "query_id long, query_code long, row long, id long, distance long")
        met = met if best is None else best.unionByName(met)
        best = written(met.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"), "best")
        reached = best.groupBy(*key).agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        sure = (F.col("n") >= min(k, n)) & (F.col("far") <= SEGMENTS * (radius + 1) - 1)
        most = F.when(F.col("n") >= k, F.col("far")).otherwise(SEGMENTS * BITS).cast("long").alias("most")
        waiting = waiting.select(*key).join(reached, key, "left").filter(~F.coalesce(sure, F.lit(n == 0))).select(*key, most)
        if (waiting := written(waiting, "waiting")).isEmpty():
            break
    return best.withColumn("rank", rank).select("query_id", "rank", F.col("id").alias(id_col), "distance")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(v, v.filter("vec_id % 50 = 0"))


OP2_SQL = """
WITH p AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: ((z[1] > 0) <> (z[2] > 0))::INT))::BIGINT AS distance
  FROM embeddings AS q, embeddings AS v WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
