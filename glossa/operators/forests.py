"""Extremely randomised trees and boosting by reweighting, on features that are put into bins once.

Both grow trees level by level from sums of row weights by tree, node, feature, bin and class: tasks make them for
batches, Spark adds them up, and the driver picks splits from sums whose number doesn't grow with the rows. All trees of
a forest share each pass; a boosted tree leaves a new weight in every row, a column that each round writes anew.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.working import written
from .boosting import BINS, Tree, _binned, _lists, _matrix, quantile_edges

#: Sums that a task holds at most in a pass: 8 bytes each. More trees than fit are grown one group after the other.
CELLS = 1 << 23
COUNTS = "tree int, node int, slot int, bin int, class int, w double, n long"


@dataclass
class ClassTree(Tree):
    """A tree whose ``value`` is, for each node, the weight of each class. ``drawn`` are the features that each node may split on."""

    classes: int = 2
    drawn: np.ndarray = field(default=None)

    def __post_init__(self):
        super().__post_init__()
        self.value = np.zeros((len(self.feature), self.classes))

    def shares(self, bins: np.ndarray) -> np.ndarray:
        """Shares of the classes in each row's leaf."""
        v = self.value[self.nodes(bins, self.depth)]
        return v / np.maximum(v.sum(axis=1, keepdims=True), 1e-300)


@dataclass
class Voting:
    """Trees that vote: a forest by the mean of the shares in their leaves, reweighted trees by their leaf's class and their own weight."""

    edges: list
    classes: int
    trees: list = field(default_factory=list)
    say: list = field(default_factory=list)  # weights of reweighted trees, none in a forest

    def votes(self, x: np.ndarray) -> np.ndarray:
        bins, out = _binned(x, [np.array(e) for e in self.edges]), np.zeros((len(x), self.classes))
        for i, t in enumerate(self.trees):
            s = t.shares(bins)
            out += s if not self.say else self.say[i] * np.eye(self.classes)[s.argmax(axis=1)]
        total = out.sum(axis=1, keepdims=True)
        return np.where(total > 0, out / np.where(total > 0, total, 1), 1 / self.classes)

    def probabilities(self, features: Column) -> Column:
        @F.pandas_udf("array<double>")
        def run(batch):
            import pandas as pd

            return pd.Series(list(self.votes(_matrix(pa.array(batch, pa.list_(pa.float64()), from_pandas=True), len(self.edges)))), dtype=object)

        return run(features)

    def transform(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """``rows`` with probability (array<double>) and prediction (double, the first of equal ones)."""
        out = rows.withColumn("probability", self.probabilities(F.col(features).cast("array<double>")))
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


def class_sums(rows: DataFrame, trees: list[ClassTree], level: int, bins: int) -> DataFrame:
    """COUNTS of rows (bins, label, weight): weights and rows by tree, node of the level, slot of its drawn features, bin and class."""
    sent = rows.sparkSession.sparkContext.broadcast(trees)
    low, width, slots, classes = 2**level - 1, 2**level, trees[0].drawn.shape[1], trees[0].classes
    shape = (width, slots, bins, classes)

    def run(batches):
        sums = np.zeros((2, len(sent.value), math.prod(shape)))
        for b in batches:
            if not b.num_rows:
                continue
            x, label, weight = _matrix(b.column(0), len(b.column(0)[0]), np.int64), b.column(1).to_numpy(), b.column(2).to_numpy()
            for i, t in enumerate(sent.value):
                node = t.nodes(x, level)
                inside = np.flatnonzero(node >= low)  # rows of leaves above this level are done
                seen = np.take_along_axis(x[inside], t.drawn[node[inside]], axis=1)
                at = (((node[inside, None] - low) * slots + np.arange(slots)) * bins + seen) * classes + label[inside, None]
                sums[0, i] += np.bincount(at.ravel(), np.repeat(weight[inside], slots), sums.shape[2])
                sums[1, i] += np.bincount(at.ravel(), minlength=sums.shape[2])
        i, at = np.nonzero(sums[1])
        node, slot, own, k = np.unravel_index(at, shape)
        if len(i):
            cols = [pa.array(c.astype(np.int32)) for c in (i, node + low, slot, own, k)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sums[0, i, at]), pa.array(sums[1, i, at].astype(np.int64))], names=["tree", "node", "slot", "bin", "class", "w", "n"])

    made = rows.select("bins", "label", "weight").mapInArrow(run, COUNTS)
    return made.groupBy("tree", "node", "slot", "bin", "class").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))


def gini_gain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What splits lower the weight times Gini impurity by, of class weights on the last axis."""
    of = lambda c: (c * c).sum(axis=-1) / np.maximum(c.sum(axis=-1), 1e-300)
    return of(left) + of(right) - of(left + right)


def _split(tree: ClassTree, at: int, w: np.ndarray, n: np.ndarray, least: int, rng) -> None:
    """Sets a node's split from sums (slot, bin, class): the best of all cuts or, with ``rng``, of one random cut a feature."""
    left, rows = np.cumsum(w, axis=1), np.cumsum(n.sum(axis=2), axis=1)
    gain = gini_gain(left, left[:, -1:] - left)
    gain = np.where((rows >= least) & (rows[:, -1:] - rows >= least), gain, -np.inf)
    if rng is not None:
        for slot in range(len(gain)):
            seen = np.flatnonzero(n[slot].sum(axis=1))
            cut = int(rng.integers(seen[0], seen[-1])) if len(seen) > 1 else -1
            gain[slot, np.arange(gain.shape[1]) != cut] = -np.inf
    slot, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[slot, cut] > 1e-12 * w.sum():
        tree.feature[at], tree.split[at] = tree.drawn[at, slot], cut


def _grow(rows: DataFrame, trees: list[ClassTree], bins: int, least: int, seed: int | None = None) -> None:
    """Grows trees, with random cuts if there is a seed, that share their passes: one a level, or some where the sums of all exceed CELLS."""
    depth, slots, classes = trees[0].depth, trees[0].drawn.shape[1], trees[0].classes
    for level in range(depth + 1):
        together = max(1, CELLS // (2 * 2**level * slots * bins * classes))
        for first in range(0, len(trees), together):
            group = trees[first : first + together]
            t = class_sums(rows, group, level, bins).toArrow()
            key = [t[c].to_numpy() for c in ("tree", "node", "slot", "bin", "class")]
            sums = np.zeros((2, len(group), 2**level, slots, bins, classes))
            for i, c in enumerate("wn"):
                sums[i, key[0], key[1] - (2**level - 1), key[2], key[3], key[4]] = t[c].to_numpy()
            for i, tree in enumerate(group):
                for node in np.flatnonzero(sums[1, i].sum(axis=(1, 2, 3))):
                    at = node + 2**level - 1
                    tree.value[at] = sums[0, i, node, 0].sum(axis=0)
                    if level < depth:
                        rng = None if seed is None else np.random.default_rng([seed, first + i, at, 1])
                        _split(tree, at, *sums[:, i, node], least, rng)


def _prepared(rows: DataFrame, classes: int, n_features: int, features: str, label: str, bins: int) -> tuple[DataFrame, list]:
    """((bins, label, weight) of rows with a label, edges of the bins)."""
    rows = rows.select(F.col(features).cast("array<double>").alias("features"), F.col(label).cast("int").alias("label")).filter(F.col("label").between(0, classes - 1))
    rows = written(rows, "rows")
    edges = quantile_edges(rows, "features", n_features, bins)

    def run(batches):
        for b in batches:
            x = _binned(_matrix(b.column(0), n_features), [np.array(e) for e in edges])
            yield pa.RecordBatch.from_arrays([_lists(x.astype(np.int32), pa.int32()), b.column(1), pa.array(np.ones(b.num_rows))], names=["bins", "label", "weight"])

    return written(rows.mapInArrow(run, "bins array<int>, label int, weight double"), "bins"), edges


def fit_extra_trees(
    rows: DataFrame, classes: int, n_features: int, features: str = "features", label: str = "label",
    trees: int = 20, depth: int = 6, tried: int | None = None, least: int = 2, bins: int = BINS, seed: int = 209,
) -> Voting:
    """Extremely randomised trees on all rows (features array<double>, label 0 to ``classes`` - 1).

    Each node draws ``tried`` features (by default the root of their number) and one cut for each, between the
    lowest and the highest bin that its rows have, and takes the best by Gini impurity. Draws depend on the seed, the tree
    and the node alone, so that the same rows give the same trees. Rows of another label or none are left out; a
    feature that is null or NaN is in the last bin. Without rows every class is as likely.
    """
    ready, edges = _prepared(rows, classes, n_features, features, label, bins)
    tried = min(n_features, tried or max(1, round(math.sqrt(n_features))))
    draw = lambda i, node: np.random.default_rng([seed, i, node]).choice(n_features, tried, replace=False)
    made = [ClassTree(depth, classes=classes, drawn=np.stack([draw(i, node) for node in range(2 ** (depth + 1) - 1)])) for i in range(trees)]
    _grow(ready, made, bins, least, seed)
    return Voting(edges, classes, made)


def fit_reweighted(
    rows: DataFrame, classes: int, n_features: int, features: str = "features", label: str = "label",
    rounds: int = 10, depth: int = 1, rate: float = 1.0, least: int = 1, bins: int = BINS,
) -> Voting:
    """Boosting for several classes by weights of rows: a tree's error e gives it the say ``rate`` (ln((1 - e) / e) + ln(classes - 1)).

    Rows that a tree gets wrong weigh exp(say) times as much in the next round. A tree without errors ends the
    rounds; so does one no better than a guess, which is left out unless it is the first. The error comes from the sums that grew the
    tree, so that a round is a pass for each level and one that writes the weights. Rows, labels and nulls as for
    ``fit_extra_trees``.
    """
    state, edges = _prepared(rows, classes, n_features, features, label, bins)
    model, every = Voting(edges, classes), np.tile(np.arange(n_features), (2 ** (depth + 1) - 1, 1))
    for i in range(rounds):
        tree = ClassTree(depth, classes=classes, drawn=every)
        _grow(state, [tree], bins, least)
        leaves = tree.value[tree.feature < 0]
        total = leaves.sum()
        wrong = total - leaves.max(axis=1).sum()
        error = wrong / total if total else 1.0
        if error >= 1 - 1 / classes - 1e-12:
            if not i and total:
                model.trees, model.say = [tree], [1.0]
            break
        error = max(error, 1e-12)
        say = rate * (math.log((1 - error) / error) + math.log(classes - 1))
        model.trees.append(tree)
        model.say.append(say)
        if error <= 1e-12 or i + 1 == rounds:
            break
        scale = 1 / (total - wrong + wrong * math.exp(say))  # weights add up to 1 after the first round
        state = written(state.mapInArrow(_reweigher(tree, n_features, math.exp(say), scale), "bins array<int>, label int, weight double"), "state")
    return model


def _reweigher(tree: ClassTree, n_features: int, more: float, scale: float):
    def run(batches):
        for b in batches:
            x = _matrix(b.column(0), n_features, np.int64)
            wrong = tree.shares(x).argmax(axis=1) != b.column(1).to_numpy()
            weight = b.column(2).to_numpy() * np.where(wrong, more, 1.0) * scale
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(weight)], names=["bins", "label", "weight"])

    return run
