"""Nearest neighbours by a random-projection tree, exact: leaves whose distance can't be ruled out are all searched.

Each level of the tree has a direction, orthogonal to those of the other levels, and each node a threshold, so that a
leaf is a box in the directions and a query's distance from the box is at most that from any row inside. A query meets its own leaf first; its
k-th distance there says which other leaves it must meet.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.working import written
from .boosting import _matrix

LEAF = 2048  # rows that a leaf is meant to have, as far as the sample tells
SAMPLE = 20_000  # rows that directions and thresholds are made from
BLOCK = 4096  # rows of a leaf, or queries, that a task compares at once
FOUND = "query long, key long, label int, distance double"


@dataclass
class Projections:
    """``directions`` (levels, width) are orthonormal; ``cuts`` are thresholds of nodes, as in a heap. A row goes right if it exceeds the cut."""

    directions: np.ndarray
    cuts: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.cuts) + 1

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at, p = np.zeros(len(x), int), x @ self.directions.T
        for level in range(len(self.directions)):
            at = 2 * at + 1 + (p[:, level] > self.cuts[at])
        return at - len(self.cuts)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """(rows, leaves): what rows are at least away from every row of a leaf."""
        p, out = x @ self.directions.T, np.zeros((len(x), 1))
        for level in range(len(self.directions)):
            gap = p[:, level, None] - self.cuts[None, 2**level - 1 : 2 ** (level + 1) - 1]
            out = np.stack([out + np.maximum(gap, 0) ** 2, out + np.minimum(gap, 0) ** 2], axis=2).reshape(len(x), -1)
        return np.sqrt(out)


@dataclass
class Index:
    """Rows (leaf, block, key, label, vec) of an index, its tree, and the number of blocks of each leaf that has rows."""

    rows: DataFrame
    tree: Projections
    width: int
    blocks: dict


def _plain(rows: DataFrame, key: str, vec: str, width: int, *more) -> DataFrame:
    """Rows whose vector has ``width`` finite numbers; others have no distance from any row."""
    out = rows.select(F.col(key).cast("long").alias("key"), *more, F.col(vec).cast("array<double>").alias("vec"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return out.filter(F.col("key").isNotNull() & (F.size("vec") == width) & ~F.exists("vec", bad))


def projections(sample: np.ndarray, depth: int, seed: int) -> Projections:
    """Random orthonormal directions, thresholds at the medians of what reaches a node of the sample."""
    width = sample.shape[1]
    directions = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))[0].T[: min(depth, width)]
    cuts, at, p = np.zeros(2 ** len(directions) - 1), np.zeros(len(sample), int), sample @ directions.T
    for level in range(len(directions)):
        for node in range(2**level - 1, 2 ** (level + 1) - 1):
            here = p[at == node, level]
            cuts[node] = np.median(here) if len(here) else 0.0
        at = 2 * at + 1 + (p[:, level] > cuts[at])
    return Projections(directions, cuts)


def build_index(rows: DataFrame, key: str, vec: str, label: str, width: int, leaf: int = LEAF, seed: int = 209) -> Index:
    """An index of all rows with a key (unique) and a vector of ``width`` finite numbers; others are left out.

    The tree is made from SAMPLE rows, the first by a hash of the key, and has at most 4096 leaves; all rows are put
    into it. A leaf of many rows, such as copies, is cut into blocks of about BLOCK rows.
    """
    plain = written(_plain(rows, key, vec, width, F.col(label).cast("int").alias("label")), "points")
    count = plain.count()
    sample = plain.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vec").toArrow()
    depth = max(0, min(math.ceil(math.log2(max(count, 1) / leaf)), int(math.log2(max(sample.num_rows, 8) / 8)), 12))
    tree = projections(_matrix(sample["vec"], width), depth, seed)

    def run(batches):
        for b in batches:
            at = tree.leaf(_matrix(b.column(2), width)) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *b.columns], names=["leaf", "key", "label", "vec"])

    placed = written(plain.mapInArrow(run, "leaf int, key long, label int, vec array<double>"), "placed")
    blocks = {r["leaf"]: -(-r["count"] // BLOCK) for r in placed.groupBy("leaf").count().collect()}  # a row a leaf
    return Index(placed.withColumn("block", _block(F.col("leaf"), blocks, F.xxhash64("key"))), tree, width, blocks)


def _block(leaf, blocks: dict, name):
    number = F.get(F.array(*[F.lit(blocks.get(i, 1)) for i in range(max(blocks, default=0) + 1)]), leaf)
    return F.pmod(name, F.coalesce(number, F.lit(1))).cast("int")


def closest(queries: np.ndarray, rows: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k closest rows, equal distances by key. Distances are of differences, as products round."""
    q2, r2 = (queries**2).sum(axis=1)[:, None], (rows**2).sum(axis=1)[None]
    near = q2 + r2 - 2 * queries @ rows.T
    kth = np.partition(near, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1]
    i, j = np.nonzero(near <= kth[:, None] + 1e-9 * (q2 + r2.max()))
    found = np.empty(len(i))
    for s in range(0, len(i), BLOCK):
        found[s : s + BLOCK] = np.sqrt(((queries[i[s : s + BLOCK]] - rows[j[s : s + BLOCK]]) ** 2).sum(axis=1))
    order = np.lexsort((keys[j], found, i))
    i, j, found = i[order], j[order], found[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], found[place < k]


def _meet(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """FOUND: the k closest of each block that queries (query, vec, leaf) of ``asked`` have to meet."""
    n_queries = {r["leaf"]: -(-r["count"] // BLOCK) for r in asked.groupBy("leaf").count().collect()}
    blocks = F.get(F.array(*[F.lit(index.blocks.get(i, 0)) for i in range(index.tree.leaves)]), F.col("leaf"))
    chunks = F.get(F.array(*[F.lit(n_queries.get(i, 0)) for i in range(index.tree.leaves)]), F.col("leaf"))
    every = lambda n: F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: (i - 1).cast("int")))
    queries = asked.withColumn("chunk", _block(F.col("leaf"), n_queries, F.xxhash64("query")))
    queries = queries.filter(blocks > 0).withColumn("block", every(blocks))
    rows = index.rows.filter(chunks > 0).withColumn("chunk", every(chunks))
    width = index.width

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "label": pa.array([], pa.int32()), "distance": pa.array([], pa.float64())})
        keys, x, y = r["key"].to_numpy(), _matrix(q["vec"], width), _matrix(r["vec"], width)
        parts = []
        for s in range(0, len(x), 512):
            i, j, d = closest(x[s : s + 512], y, keys, k)
            parts.append(pa.table({"query": q["query"].take(pa.array(i + s)), "key": keys[j], "label": r["label"].take(pa.array(j)), "distance": d}))
        return pa.concat_tables(parts)

    by = ("leaf", "block", "chunk")
    return queries.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(run, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))).filter(F.col("rank") <= k)


def nearest(index: Index, queries: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """(query, rank, key, label, distance): the k rows closest to each query by Euclidean distance, equal distances by key. Exact.

    Fewer than k only where the index has fewer rows. Queries without a key (unique) or a vector of the index's width
    have no neighbours. In many dimensions, or where no row is near, most leaves can't be ruled out: the work then goes towards
    queries times rows, in blocks, but the result stays exact.
    """
    tree, width = index.tree, index.width
    asked = written(_plain(queries, key, vec, width).withColumnRenamed("key", "query"), "queries")

    def own(batches):
        for b in batches:
            at = tree.leaf(_matrix(b.column(1), width)) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=["query", "vec", "leaf"])

    home = written(asked.mapInArrow(own, "query long, vec array<double>, leaf int"), "home")
    first = written(_first(_meet(index, home, k), k).drop("rank"), "first")
    bound = first.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
    far = F.when(F.col("n") >= k, F.col("far")).otherwise(float("inf")).alias("far")  # too few rows rule out nothing

    def others(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                c = b.slice(s, 256)
                x, leaf, far = _matrix(c.column(1), width), c.column(2).to_numpy(), c.column(3).to_numpy()
                least = tree.distances(x)
                least[np.arange(len(x)), leaf] = np.inf
                # a little beyond the bound, as projections round; an infinite bound takes all but the own leaf
                i, at = np.nonzero((least <= far[:, None] * (1 + 1e-9) + 1e-9 * (1 + np.abs(x).max())) & np.isfinite(least))
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([c.column(0).take(take), c.column(1).take(take), pa.array(at.astype(np.int32))], names=["query", "vec", "leaf"])

    rest = home.join(bound, "query", "left").select("query", "vec", "leaf", far)
    rest = written(rest.mapInArrow(others, "query long, vec array<double>, leaf int"), "rest")
    return _first(first.unionByName(_meet(index, rest, k)), k).select("query", "rank", "key", "label", "distance")


def told(found: DataFrame) -> DataFrame:
    """(query, prediction): the label that most neighbours have, the least of equally many. Neighbours without a label have no vote."""
    votes = found.filter("label IS NOT NULL").groupBy("query", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("query").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("prediction"))
