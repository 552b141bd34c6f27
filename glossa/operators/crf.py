"""A linear-chain conditional random field over sequences of tags, trained by Spark.

A token has a set of features, hashed to a fixed number of slots. Its score for a tag is the sum of its features'
weights; a sequence adds weights of neighbouring tags and of its first and last tag. Training needs the loss and
its gradient once a step: tasks run forward and backward over batches of sequences, Spark adds up the gradient
by weight, and the driver holds nothing but weights, whose number doesn't grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.working import written
from .models import best_paths

SLOTS = 1 << 14
MEMORY = 10  # steps whose curvature is remembered
FEATURES = "array<array<int>>"


def token_features(words: Column, context: Column, slots: int = SLOTS) -> Column:
    """Features of each word as slots: the word and its neighbours, endings, a leading letter, digits, place and context."""
    slot = lambda name, *x: F.pmod(F.xxhash64(F.lit(name), *x), F.lit(slots)).cast("int")
    low = F.transform(words, lambda w: F.lower(w))
    size = F.size(words)

    def each(w: Column, i: Column) -> Column:
        before, after = F.coalesce(F.get(low, i - 1), F.lit("^")), F.coalesce(F.get(low, i + 1), F.lit("$"))
        place = F.when(i == 0, 0).when(i == size - 1, 2).otherwise(1)
        return F.array_distinct(F.array(
            slot("bias"), slot("word", w), slot("before", before), slot("after", after), slot("end3", F.right(w, F.lit(3))), slot("end2", F.right(w, F.lit(2))),
            slot("end1", F.right(w, F.lit(1))), slot("first", F.left(w, F.lit(1))), slot("digits", w.rlike(r"^\p{Nd}+$")), slot("place", place), slot("context", context),
        ))

    return F.transform(low, each)


def _by_length(features: pa.Array | list):
    """(numbers of the sequences, length, numbers of their tokens, tokens' features flat, tokens' numbers of features), a length at a time."""
    f = features if isinstance(features, pa.Array) else pa.array(features, pa.list_(pa.list_(pa.int64())))
    of_seq, lens = _starts(f)
    tokens = f.flatten()
    of_token, sizes = _starts(tokens)
    flat = tokens.flatten().to_numpy(zero_copy_only=False)
    for n in np.unique(lens[lens > 0]).tolist():
        at = np.flatnonzero(lens == n)
        own = (of_seq[at][:, None] + np.arange(n)).ravel()
        yield at, n, own, flat[_ranges(of_token[own], sizes[own])], sizes[own]


def _starts(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins in the flattened array, and its length; nulls are empty."""
    lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(lens) - lens, lens


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one row after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Chain:
    """Weights (``slots`` x ``n_tags``, then transitions, first, last) and what follows from them for batches of sequences."""

    n_tags: int
    slots: int = SLOTS
    weights: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.weights is None:
            self.weights = np.zeros(self.slots * self.n_tags + self.n_tags * (self.n_tags + 2))

    def _parts(self) -> tuple[np.ndarray, ...]:
        k, n = self.n_tags, self.slots * self.n_tags
        return self.weights[:n].reshape(-1, k), self.weights[n : n + k * k].reshape(k, k), self.weights[n + k * k : n + k * k + k], self.weights[n + k * k + k :]

    def _emissions(self, n: int, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(sequences, n, tags), with the weights of first and last tags added."""
        own, _, first, last = self._parts()
        out, some = np.zeros((len(sizes), self.n_tags)), sizes > 0
        if some.any():
            out[some] = np.add.reduceat(own[flat], (np.cumsum(sizes) - sizes)[some], axis=0)
        out = out.reshape(-1, n, self.n_tags)
        out[:, 0] += first
        out[:, -1] += last
        return out

    def _forward_backward(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        trans, n = self._parts()[1], e.shape[1]
        ahead, back = np.empty_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0]
        for t in range(1, n):
            ahead[:, t] = _sum_exp(ahead[:, t - 1, :, None] + trans, 1) + e[:, t]
        for t in range(n - 2, -1, -1):
            back[:, t] = _sum_exp(trans + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        return ahead, back, _sum_exp(ahead[:, -1], 1)

    def loss(self, features: pa.Array | list, tags: pa.Array | list, times: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """Negative log likelihood of the sequences, each counted so many times, and its gradient; empty sequences add nothing."""
        k, total, out = self.n_tags, 0.0, np.zeros_like(self.weights)
        grad = Chain(k, self.slots, out)._parts()
        trans = self._parts()[1]
        labels = (tags if isinstance(tags, pa.Array) else pa.array(tags, pa.list_(pa.int64()))).flatten().to_numpy(zero_copy_only=False)
        for at, n, own, flat, sizes in _by_length(features):
            y, c = labels[own].reshape(-1, n), np.ones(len(at)) if times is None else times[at].astype(float)
            e = self._emissions(n, flat, sizes)
            ahead, back, z = self._forward_backward(e)
            m = np.arange(len(y))
            total += float(c @ (z - np.take_along_axis(e, y[:, :, None], 2).sum(axis=(1, 2))))
            p = np.exp(ahead + back - z[:, None, None])
            p[m[:, None], np.arange(n), y] -= 1
            p *= c[:, None, None]
            of = np.repeat(np.arange(len(own)), sizes)
            for j in range(k):
                grad[0][:, j] += np.bincount(flat, p.reshape(-1, k)[of, j], self.slots)
            grad[2][:] += p[:, 0].sum(axis=0)
            grad[3][:] += p[:, -1].sum(axis=0)
            for t in range(1, n):
                pair = np.exp(ahead[:, t - 1, :, None] + trans + (e[:, t] + back[:, t])[:, None, :] - z[:, None, None])
                grad[1][:] += np.tensordot(c, pair, 1)
                np.subtract.at(grad[1], (y[:, t - 1], y[:, t]), c)
                total -= float(c @ trans[y[:, t - 1], y[:, t]])
        return total, out

    def _column(self, kind: str, what: Callable) -> Callable[[Column], Column]:
        """``what`` gives a value a token from the emissions of sequences of one length."""

        @F.arrow_udf(kind)
        def run(features: pa.Array) -> pa.Array:
            f = pa.concat_arrays(features.chunks) if isinstance(features, pa.ChunkedArray) else features
            lens, out = _starts(f)[1], None
            for at, n, own, flat, sizes in _by_length(f):
                x = what(self._emissions(n, flat, sizes)).reshape(len(at) * n, -1)
                if out is None:
                    out = np.empty((int(lens.sum()), x.shape[1]), x.dtype)
                out[own] = x
            deep = kind.count("array") == 2
            out = np.empty((0, self.n_tags if deep else 1), float if deep else np.int32) if out is None else out
            each = pa.array(out.ravel())
            if deep:
                each = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), each)
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)).astype(np.int32)), each)

        return run

    def marginals(self, features: Column) -> Column:
        """Of each token the probability of each tag, given the whole sequence."""

        def what(e):
            ahead, back, z = self._forward_backward(e)
            return np.exp(ahead + back - z[:, None, None])

        return self._column("array<array<double>>", what)(features)

    def best(self, features: Column) -> Column:
        """The numbers of the tags of the most likely sequence."""
        return self._column("array<int>", lambda e: best_paths(e, self._parts()[1]).astype(np.int32))(features)


def loss_and_gradient(sequences: DataFrame, chain: Chain) -> tuple[float, np.ndarray]:
    """Summed over sequences (features, tags), or (features, tags, times). What tasks give is added up by weight before it reaches the driver."""
    sent = sequences.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        total, grad = 0.0, None
        for b in batches:
            loss, g = sent.value.loss(b.column(0), b.column(1), b.column(2).to_numpy() if b.num_columns > 2 else None)
            total, grad = total + loss, g if grad is None else grad + g
        if grad is not None:
            at = np.flatnonzero(grad)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(grad[at], total))], names=["at", "x"])

    own = ["features", "tags", *(["times"] if "times" in sequences.columns else [])]
    sums = sequences.select(*own).mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    sent.unpersist()
    out, at, x = np.zeros_like(chain.weights), sums["at"].to_numpy(), sums["x"].to_numpy()
    out[at[at >= 0]] = x[at >= 0]
    return float(x[at < 0].sum()), out


def fit_chain(sequences: DataFrame, n_tags: int, slots: int = SLOTS, l2: float = 0.1, steps: int = 40, tolerance: float = 1e-4) -> tuple[Chain, list[float]]:
    """(chain, losses by step) of (features array<array<int>>, tags array<int>) by limited-memory BFGS, all weights from 0.

    Sequences whose tags are null, not as many as their tokens, or no number from 0 to ``n_tags`` - 1 are left out. Stops
    when a step gains less than ``tolerance`` of the loss. ``l2`` times half the squared weights is added to the loss.
    Equal sequences are read once a step, with their number; a row with times stands for so many sequences.
    """
    ok = (F.size("tags") == F.size("features")) & F.forall("tags", lambda t: t.between(0, n_tags - 1))
    n = F.sum("times") if "times" in sequences.columns else F.count("*")
    rows = written(sequences.filter(ok).groupBy("features", "tags").agg(n.alias("times")), "sequences")

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, grad = loss_and_gradient(rows, Chain(n_tags, slots, w))
        return loss + l2 / 2 * float(w @ w), grad + l2 * w

    w = np.zeros(slots * n_tags + n_tags * (n_tags + 2))
    (loss, grad), past, losses = at(w), [], []
    for _ in range(steps):
        losses.append(loss)
        way, back = grad.copy(), []
        for s, y in reversed(past):
            a = (s @ way) / (y @ s)
            back.append(a)
            way -= a * y
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.linalg.norm(grad)))
        for (s, y), a in zip(past, reversed(back), strict=True):
            way += (a - (y @ way) / (y @ s)) * s
        slope, size = float(grad @ way), 1.0
        if slope <= 1e-12:
            break
        while True:
            new = w - size * way
            found, g = at(new)
            if found <= loss - 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        s, y = new - w, g - grad
        if s @ y > 1e-10:
            past = [*past, (s, y)][-MEMORY:]
        gain, w, loss, grad = loss - found, new, found, g
        if gain < tolerance * abs(loss):
            break
    return Chain(n_tags, slots, w), [*losses, loss]


def save_chain(spark: SparkSession, chain: Chain, path: str) -> None:
    """Write the weights that aren't 0, over what is there."""
    at = np.flatnonzero(chain.weights)
    rows = spark.createDataFrame(pa.table({"at": np.append(at, [-1, -2]), "x": np.append(chain.weights[at], [chain.n_tags, chain.slots])}))
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def load_chain(spark: SparkSession, path: str) -> Chain:
    t = spark.read.parquet(path).toArrow()
    at, x = t["at"].to_numpy(), t["x"].to_numpy()
    out = Chain(int(x[at == -1][0]), int(x[at == -2][0]))
    out.weights[at[at >= 0]] = x[at >= 0]
    return out
