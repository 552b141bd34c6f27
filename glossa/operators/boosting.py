"""Gradient boosting for several classes at once: softmax loss, one tree a class a round, on binned features.

Features are put into bins once, by quantiles of all rows. A level of a round's trees needs, of every node, feature and
bin, the sums of gradients and curvatures of its rows: tasks make them for batches, Spark adds them up, and the
driver chooses splits from sums whose number doesn't grow with the rows. Scores are a column that each round writes anew.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.working import written

BINS = 32
HISTOGRAM = "class int, node int, feature int, bin int, g double, h double, n long"


def quantile_edges(rows: DataFrame, features: str, n_features: int, bins: int = BINS) -> list[list[float]]:
    """Of each feature the distinct upper edges of all bins but the last, in one pass over all rows. Nulls and NaN count nowhere."""
    shares = [i / bins for i in range(1, bins)]
    value = lambda i: F.when(~F.isnan(F.get(features, F.lit(i))), F.get(features, F.lit(i)))
    found = rows.agg(*[F.percentile_approx(value(i), shares, 10_000).alias(str(i)) for i in range(n_features)]).first()
    return [sorted(set(found[str(i)] or [])) for i in range(n_features)]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins from 0; a value is in the first bin whose edge it doesn't exceed, NaN in the last."""
    return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], axis=1)


def _matrix(column, width: int, kind=np.float64) -> np.ndarray:
    """(rows, width) of a list column; what a row lacks is NaN or 0."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten()
    if len(flat) == len(lists) * width and not flat.null_count and not lists.null_count:
        return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)
    empty = np.nan if np.dtype(kind).kind == "f" else 0
    return np.array([[empty if v is None else v for v in [*(r or []), *[None] * width][:width]] for r in lists.to_pylist()], kind).reshape(-1, width)


@dataclass
class Tree:
    """Nodes as in a heap: the children of i are 2i + 1 and 2i + 2. A row goes left if its bin is at most the split's; feature -1 is a leaf."""

    depth: int
    feature: np.ndarray = field(default=None)
    split: np.ndarray = field(default=None)
    value: np.ndarray = field(default=None)

    def __post_init__(self):
        size = 2 ** (self.depth + 1) - 1
        if self.feature is None:
            self.feature, self.split, self.value = np.full(size, -1), np.zeros(size, int), np.zeros(size)

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after at most ``levels`` splits."""
        at = np.zeros(len(bins), int)
        for _ in range(levels):
            f = self.feature[at]
            down = 2 * at + 1 + (bins[np.arange(len(bins)), np.maximum(f, 0)] > self.split[at])
            at = np.where(f >= 0, down, at)
        return at


@dataclass
class Boosted:
    """Rounds of a tree a class on features in bins; the score of a class is its prior's logarithm and the sum of its trees' values."""

    edges: list
    start: np.ndarray
    rounds: list = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = _binned(x, [np.array(e) for e in self.edges])
        out = np.tile(self.start, (len(x), 1))
        for trees in self.rounds:
            for k, t in enumerate(trees):
                out[:, k] += t.value[t.nodes(bins, t.depth)]
        return out

    def probabilities(self, features: Column) -> Column:
        @F.pandas_udf("array<double>")
        def run(batch):
            import pandas as pd

            x = np.array([[np.nan if v is None else v for v in (r if r is not None else [None] * len(self.edges))] for r in batch], float).reshape(-1, len(self.edges))
            return pd.Series(list(_softmax(self.scores(x))), dtype=object)

        return run(features)

    def transform(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """``rows`` with probability (array<double>) and prediction (double, the first of equal ones)."""
        out = rows.withColumn("probability", self.probabilities(F.col(features)))
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


def _softmax(s: np.ndarray) -> np.ndarray:
    p = np.exp(s - s.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def node_sums(bins: np.ndarray, label: np.ndarray, scores: np.ndarray, trees: list[Tree], level: int, n_bins: int) -> np.ndarray:
    """(class, 3, node x feature x bin) of rows: sums of gradients, curvatures and rows at the nodes of a level."""
    low, width, n_features = 2**level - 1, 2**level, bins.shape[1]
    sums, p = np.zeros((len(trees), 3, width * n_features * n_bins)), _softmax(scores)
    for k, tree in enumerate(trees):
        node = tree.nodes(bins, level) - low
        inside = node >= 0  # rows of leaves above this level are done
        at = ((node[inside, None] * n_features + np.arange(n_features)) * n_bins + bins[inside]).ravel()
        g, h = (p[:, k] - (label == k))[inside], (p[:, k] * (1 - p[:, k]))[inside]
        for i, x in enumerate((g, h, np.ones(len(g)))):
            sums[k, i] += np.bincount(at, np.repeat(x, n_features), sums.shape[2])
    return sums


def sums_batch(sums: np.ndarray, level: int, n_features: int, n_bins: int) -> pa.RecordBatch:
    """The cells of ``node_sums`` that have rows, as HISTOGRAM."""
    k, at = np.nonzero(sums[:, 2])
    node, rest = np.divmod(at, n_features * n_bins)
    cols = [k, node + 2**level - 1, rest // n_bins, rest % n_bins]
    cols = [*(pa.array(c.astype(np.int32)) for c in cols), pa.array(sums[k, 0, at]), pa.array(sums[k, 1, at]), pa.array(sums[k, 2, at].astype(np.int64))]
    return pa.RecordBatch.from_arrays(cols, names=["class", "node", "feature", "bin", "g", "h", "n"])


def histograms(rows: DataFrame, trees: list[Tree], level: int, n_features: int, n_bins: int = BINS) -> DataFrame:
    """HISTOGRAM of rows (bins, label, scores): sums of gradients, curvatures and rows by class, node of the level, feature and bin."""
    sent, classes = rows.sparkSession.sparkContext.broadcast(trees), len(trees)

    def run(batches):
        sums = None
        for b in batches:
            if b.num_rows:
                more = node_sums(_matrix(b.column(0), n_features, np.int64), b.column(1).to_numpy(), _matrix(b.column(2), classes), sent.value, level, n_bins)
                sums = more if sums is None else sums + more
        if sums is not None:
            yield sums_batch(sums, level, n_features, n_bins)

    made = rows.select("bins", "label", "scores").mapInArrow(run, HISTOGRAM)
    return made.groupBy("class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, l2: float, least: int) -> tuple[float, int, int]:
    """(gain, feature, bin) of sums by feature and bin; the first of equal gains. Feature -1 if no split gains."""
    left = [np.cumsum(x, axis=1) for x in (g, h, n)]
    right = [x.sum(axis=1, keepdims=True) - c for x, c in zip((g, h, n), left, strict=True)]
    of = lambda a, b: a * a / (b + l2)
    gain = of(left[0], left[1]) + of(right[0], right[1]) - of(g[0].sum(), h[0].sum())
    gain = np.where((left[2] >= least) & (right[2] >= least), gain, -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (float(gain[f, b]), int(f), int(b)) if gain[f, b] > 1e-9 else (0.0, -1, 0)


def split_level(trees: list[Tree], t: pa.Table, level: int, n_features: int, bins: int, rate: float, l2: float, least: int) -> None:
    """Sets values and, above the last level, splits of the nodes of a level from their HISTOGRAM."""
    key = [t[c].to_numpy() for c in ("class", "node", "feature", "bin")]
    sums = np.zeros((3, len(trees), 2**level, n_features, bins))
    for i, c in enumerate("ghn"):
        sums[i, key[0], key[1] - (2**level - 1), key[2], key[3]] = t[c].to_numpy()
    for k, tree in enumerate(trees):
        for node in range(2**level):
            g, h, n = sums[:, k, node]
            if not n[0].sum():
                continue
            at = node + 2**level - 1
            tree.value[at] = -rate * g[0].sum() / (h[0].sum() + l2)
            if level < tree.depth:
                _, tree.feature[at], tree.split[at] = best_split(g, h, n, l2, least)


def _grow(rows: DataFrame, classes: int, n_features: int, bins: int, depth: int, rate: float, l2: float, least: int) -> list[Tree]:
    trees = [Tree(depth) for _ in range(classes)]
    for level in range(depth + 1):
        t = histograms(rows, trees, level, n_features, bins).toArrow()  # classes x nodes x features x bins at most
        split_level(trees, t, level, n_features, bins, rate, l2, least)
    return trees


def fit_boosted(
    rows: DataFrame, classes: int, n_features: int, features: str = "features", label: str = "label",
    rounds: int = 10, depth: int = 3, rate: float = 0.3, l2: float = 1.0, least: int = 5, bins: int = BINS,
) -> Boosted:
    """Fitted on (features array<double>, label 0 to ``classes`` - 1); rows of another label or none are left out.

    A feature that is null or NaN is in the last bin, as are all values beyond the last edge. The same rows
    give the same model but for the order in which sums are added up.
    """
    rows = rows.select(F.col(features).cast("array<double>").alias("features"), F.col(label).cast("int").alias("label")).filter(F.col("label").between(0, classes - 1))
    rows = written(rows, "rows")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    prior = np.array([counts.get(k, 0) + 1.0 for k in range(classes)])
    model = Boosted(quantile_edges(rows, "features", n_features, bins), np.log(prior / prior.sum()))
    state = written(rows.mapInArrow(_binner(model.edges, model.start), "bins array<int>, label int, scores array<double>"), "state")
    for i in range(rounds):
        trees = _grow(state, classes, n_features, bins, depth, rate, l2, least)
        model.rounds.append(trees)
        if i + 1 < rounds:
            state = written(state.mapInArrow(_adder(trees, n_features), "bins array<int>, label int, scores array<double>"), "state")
    return model


def _lists(x: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))


def _binner(edges: list, start: np.ndarray):
    def run(batches):
        for b in batches:
            bins = _binned(_matrix(b.column(0), len(edges)), [np.array(e) for e in edges])
            yield pa.RecordBatch.from_arrays([_lists(bins.astype(np.int32), pa.int32()), b.column(1), _lists(np.tile(start, (b.num_rows, 1)), pa.float64())], names=["bins", "label", "scores"])

    return run


def _adder(trees: list[Tree], n_features: int):
    def run(batches):
        for b in batches:
            bins, scores = _matrix(b.column(0), n_features, np.int64), _matrix(b.column(2), len(trees)).copy()
            for k, t in enumerate(trees):
                scores[:, k] += t.value[t.nodes(bins, t.depth)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(scores, pa.float64())], names=["bins", "label", "scores"])

    return run
