"""A tagger in context: an averaged structured perceptron over tags and the two tags before, decoded with a beam.

Training is by iterative parameter mixing: each task goes over its own sequences from common weights, one
sequence after the other; Spark averages what tasks have learned, weight by weight, and the next round begins with that.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.working import written
from .crf import SLOTS

BEAM = 16


@dataclass
class BeamTagger:
    """Weights of features by tag (``slots`` x ``n_tags``) and of three tags in turn; tag ``n_tags`` stands before the first."""

    n_tags: int
    slots: int = SLOTS
    beam: int = BEAM
    own: np.ndarray = field(default=None)
    chain: np.ndarray = field(default=None)

    def __post_init__(self):
        k = self.n_tags
        self.own = np.zeros((self.slots, k)) if self.own is None else self.own
        self.chain = np.zeros((k + 1, k + 1, k)) if self.chain is None else self.chain

    def decode(self, features: list, gold: list | None = None) -> list[int]:
        """The best tags that the beam keeps. With ``gold``, ends where the beam loses it, with the best tags up to there.

        Beginnings of equal last two tags are one, the best, as what follows depends on no more; a beam of
        ``n_tags`` squared is exact.
        """
        k = self.n_tags
        first, last, score = np.array([k]), np.array([k]), np.zeros(1)
        steps, true = [], 0  # true: the place of gold's beginning in the beam
        for t, f in enumerate(features):
            every = score[:, None] + self.chain[first, last] + self.own[f].sum(axis=0)
            flat = every.ravel()
            order = np.argsort(-flat, kind="stable")
            _, kept = np.unique(last[order // k] * k + order % k, return_index=True)
            order = order[np.sort(kept)[: self.beam]]
            back = order // k
            steps.append((back, order % k))
            if gold is not None:
                at = np.flatnonzero((back == true) & (order % k == gold[t]))
                if not len(at):
                    break
                true = int(at[0])
            first, last, score = last[back], order % k, flat[order]
        path, at = [], 0
        for back, tag in reversed(steps):
            path.append(int(tag[at]))
            at = back[at]
        return path[::-1]

    def score(self, features: list, tags: list) -> float:
        padded = [self.n_tags, self.n_tags, *tags]
        return float(sum(self.own[f, y].sum() + self.chain[padded[t], padded[t + 1], y] for t, (f, y) in enumerate(zip(features, tags, strict=True))))

    def best(self, features: Column) -> Column:
        """The numbers of the tags of each sequence, none for null."""

        @F.pandas_udf("array<int>")
        def run(batch):
            import pandas as pd

            return pd.Series([[] if f is None else self.decode(f) for f in batch], dtype=object)

        return run(features)


class _Learner:
    """A tagger and the sum of its weights over all sequences that it has gone over."""

    def __init__(self, start: BeamTagger):
        self.tagger = BeamTagger(start.n_tags, start.slots, start.beam, start.own.copy(), start.chain.copy())
        self.late = [np.zeros_like(start.own), np.zeros_like(start.chain)]  # what each change lacks in the sums before it
        self.seen = 0

    def learn(self, features: list, gold: list) -> None:
        k, found = self.tagger.n_tags, self.tagger.decode(features, gold)
        gold = gold[: len(found)]
        if found != gold:
            for tags, sign in ((gold, 1.0), (found, -1.0)):
                padded = [k, k, *tags]
                for t, y in enumerate(tags):
                    for target, size in ((0, sign), (1, sign * self.seen)):
                        own, chain = (self.tagger.own, self.tagger.chain) if target == 0 else self.late
                        own[features[t], y] += size
                        chain[padded[t], padded[t + 1], y] += size
        self.seen += 1

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """All weights, and their sums over the sequences seen."""
        now = np.concatenate((self.tagger.own.ravel(), self.tagger.chain.ravel()))
        return now, self.seen * now - np.concatenate([x.ravel() for x in self.late])


def one_round(sequences: DataFrame, start: BeamTagger) -> tuple[BeamTagger, np.ndarray, int]:
    """(mixed weights, sums over all sequences, sequences) after each task has gone over its sequences once, from ``start`` on."""
    sent = sequences.sparkSession.sparkContext.broadcast(start)

    def run(batches):
        learner = _Learner(sent.value)
        for b in batches:
            for f, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                learner.learn(f, y)
        if learner.seen:
            now, total = learner.weights()
            at = np.flatnonzero((now != 0) | (total != 0))
            cols = [np.append(at, -1), np.append(now[at], 1.0), np.append(total[at], learner.seen)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["at", "now", "total"])

    sums = sequences.select("features", "tags").mapInArrow(run, "at long, now double, total double").groupBy("at").agg(F.sum("now").alias("now"), F.sum("total").alias("total")).toArrow()
    sent.unpersist()
    at, now, total = (sums[c].to_numpy() for c in ("at", "now", "total"))
    size = start.own.size
    mixed, sums = np.zeros(size + start.chain.size), np.zeros(size + start.chain.size)
    tasks, seen = (float(x[at < 0].sum()) for x in (now, total))
    mixed[at[at >= 0]], sums[at[at >= 0]] = now[at >= 0] / max(tasks, 1.0), total[at >= 0]
    return BeamTagger(start.n_tags, start.slots, start.beam, mixed[:size].reshape(start.own.shape), mixed[size:].reshape(start.chain.shape)), sums, int(seen)


def fit_beam_tagger(sequences: DataFrame, n_tags: int, slots: int = SLOTS, rounds: int = 5, beam: int = BEAM) -> BeamTagger:
    """Trained on (features array<array<int>>, tags array<int>); the weights are averaged over all sequences of all rounds.

    Sequences whose tags are null, not as many as their tokens, or no number from 0 to ``n_tags`` - 1 are left out.
    """
    ok = (F.size("tags") == F.size("features")) & F.forall("tags", lambda t: t.between(0, n_tags - 1))
    rows = written(sequences.select("features", "tags").filter(ok), "sequences")
    tagger, total, seen = BeamTagger(n_tags, slots, beam), 0.0, 0
    for _ in range(rounds):
        tagger, sums, n = one_round(rows, tagger)
        total, seen = total + sums, seen + n
    mean = total / max(seen, 1)
    return BeamTagger(n_tags, slots, beam, mean[: tagger.own.size].reshape(tagger.own.shape), mean[tagger.own.size :].reshape(tagger.chain.shape))
