"""Search for the parameters of boosted trees, where candidates and folds share every pass over the rows.

Features are put into bins once. A pass at a level adds up the histograms of all candidates' trees of all folds, and
a round is scored on the rows held out as it is added, so that every number of rounds of a candidate has its score.
After some rounds the worse half of the candidates goes no further.
"""

from __future__ import annotations

import itertools
import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.working import written
from . import boosting
from .boosting import BINS, HISTOGRAM, Boosted, Tree, _lists, _matrix, _softmax

DEFAULTS = {"depth": 3, "rate": 0.3, "l2": 1.0, "least": 5}
#: Scores by candidate, fold that the model hasn't seen, and class; loss and hit by candidate, of the model that hasn't seen the row.
STATE = "bins array<int>, label int, fold int, scores array<double>, loss array<double>, hit array<double>"
SCORES = "params string, rounds int, mean_loss double, std_loss double, mean_accuracy double, std_accuracy double, best boolean"


@dataclass
class Search:
    """``best`` has the winner's parameters and rounds; ``table`` a row a candidate and number of rounds, ``passes`` the passes over the rows."""

    best: dict
    table: DataFrame
    passes: int
    grown: list = field(default_factory=list)  # rounds grown of each candidate


def _pass(state: DataFrame, models: list[tuple[int, list[Tree]]], slots: list[int], level: int, n_features: int, classes: int, bins: int) -> pa.Table:
    """HISTOGRAM with model of the level's nodes: rows of a model's own fold, which it is held against, are not in its sums.

    ``slots`` are the places of the models' scores. A task holds models x classes x nodes x features x bins sums, whatever its rows.
    """
    sent = state.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        sums: list = [None] * len(sent.value)
        for b in batches:
            if not b.num_rows:
                continue
            x, label, fold = _matrix(b.column(0), n_features, np.int64), b.column(1).to_numpy(), b.column(2).to_numpy()
            width = len(_first(b.column(3)))
            scores = _matrix(b.column(3), width).reshape(len(x), width // classes, classes)
            for m, (own, trees) in enumerate(sent.value):
                rows = fold != own
                if level <= trees[0].depth and rows.any():
                    more = boosting.node_sums(x[rows], label[rows], scores[rows, slots[m]], trees, level, bins)
                    sums[m] = more if sums[m] is None else sums[m] + more
        for m, s in enumerate(sums):
            if s is not None:
                made = boosting.sums_batch(s, level, n_features, bins)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(made.num_rows, m, np.int32)), *made.columns], names=["model", *made.schema.names])

    made = state.select("bins", "label", "fold", "scores").mapInArrow(run, f"model int, {HISTOGRAM}")
    return made.groupBy("model", "class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()


def _add(state: DataFrame, models: list[tuple[int, list[Tree]]], kept: list[int], n_folds: int, n_features: int, classes: int) -> DataFrame:
    """The state of the candidates in ``kept`` (by place) with a round's trees added, and each row's loss and hit by them where it is held out."""
    sent = state.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for b in batches:
            x, label, fold = _matrix(b.column(0), n_features, np.int64), b.column(1).to_numpy(), b.column(2).to_numpy()
            before = len(_first(b.column(3))) // classes if b.num_rows else 0
            scores = _matrix(b.column(3), before * classes).reshape(len(x), before, classes)
            scores = scores[:, [c * n_folds + f for c in kept for f in range(n_folds)]].copy() if b.num_rows else np.zeros((0, len(kept) * n_folds, classes))
            for m, (_, trees) in enumerate(sent.value):
                for k, t in enumerate(trees):
                    scores[:, m, k] += t.value[t.nodes(x, t.depth)]
            out = scores.reshape(len(x), len(kept), n_folds, classes)[np.arange(len(x)), :, fold]  # of the model that hasn't seen the row
            p = _softmax(out.reshape(-1, classes)).reshape(out.shape)
            loss = -np.log(np.maximum(p[np.arange(len(x)), :, label], 1e-15))
            hit = (p.argmax(axis=2) == label[:, None]).astype(float)
            flat = scores.reshape(len(x), len(kept) * n_folds * classes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _lists(flat, pa.float64()), _lists(loss, pa.float64()), _lists(hit, pa.float64())], names=["bins", "label", "fold", "scores", "loss", "hit"])

    return written(state.mapInArrow(run, STATE), "search")


def _first(column) -> list:
    return column[0].as_py()


def search_boosted(
    rows: DataFrame, classes: int, n_features: int, grid: dict[str, list], rungs: list[int], features: str = "features", label: str = "label",
    fold: str = "fold", n_folds: int = 5, eta: float = 2.0, sure: float = 2.0, bins: int = BINS,
) -> Search:
    """Every combination of ``grid`` (depth, rate, l2, least), cross-validated over the column ``fold``, 0 to ``n_folds`` - 1.

    All candidates grow to ``rungs[0]`` rounds; after each rung but the last, the ``1 / eta`` with the least mean loss
    go on to the next (rounded up; of equal ones the first), and with them those that aren't told apart from the last
    of these: whose loss is above its by ``sure`` standard errors of the differences over folds or less. With
    ``sure=0`` n candidates make n * (rungs[0] + (rungs[1] - rungs[0]) / eta + ...) rounds or so, but of two that are
    alike the better one may go; with ``eta=1`` none does. A round is a pass a level for all candidates and folds together,
    and one that adds it. The best is the candidate and number of rounds of least
    mean loss among those that reach the last rung, as rungs compare what has grown as far. Edges of bins are of
    all rows, held out ones too: they hold no label. Rows of another label or fold are left out.
    """
    if sorted(set(rungs)) != list(rungs) or not rungs or rungs[0] < 1 or eta < 1 or n_folds < 2:
        raise ValueError("rungs must rise from 1 or more, eta be 1 or more, and folds two or more")
    names = sorted(grid)
    if lacking := [n for n in names if n not in DEFAULTS]:
        raise ValueError(f"no parameter of boosted trees: {', '.join(lacking)}")
    candidates = [{**DEFAULTS, **dict(zip(names, v, strict=True))} for v in itertools.product(*(grid[n] for n in names))]
    rows = rows.select(F.col(features).cast("array<double>").alias("features"), F.col(label).cast("int").alias("label"), F.col(fold).cast("int").alias("fold"))
    rows = written(rows.filter(F.col("label").between(0, classes - 1) & F.col("fold").between(0, n_folds - 1)), "rows")
    counts = np.zeros((n_folds, classes))
    for r in rows.groupBy("fold", "label").count().collect():  # folds x classes at most
        counts[r["fold"], r["label"]] = r["count"]
    if not counts.any():
        raise ValueError("no rows to learn from")
    prior = counts.sum(axis=0) - counts + 1
    starts = np.log(prior / prior.sum(axis=1, keepdims=True))
    edges = boosting.quantile_edges(rows, "features", n_features, bins)
    state = rows.mapInArrow(_start(edges, starts, len(candidates)), STATE)
    state, passes, alive, table = written(state, "search"), 3, list(range(len(candidates))), []
    kept, grown = list(range(len(candidates))), [0] * len(candidates)
    fit_sizes = counts.sum(axis=1)
    for done in range(1, rungs[-1] + 1):
        alive = [alive[i] for i in kept]  # scores of those that were dropped stay until the round is added
        slots = [i * n_folds + f for i in kept for f in range(n_folds)]
        models = [(f, [Tree(candidates[c]["depth"]) for _ in range(classes)]) for c in alive for f in range(n_folds)]
        for level in range(max(candidates[c]["depth"] for c in alive) + 1):
            t = _pass(state, models, slots, level, n_features, classes, bins)
            passes += 1
            own = t["model"].to_numpy()
            for m, (_, trees) in enumerate(models):
                p = candidates[alive[m // n_folds]]
                if level <= p["depth"]:
                    boosting.split_level(trees, t.filter(pa.array(own == m)), level, n_features, bins, p["rate"], p["l2"], p["least"])
        state = _add(state, models, kept, n_folds, n_features, classes)
        each = [f(F.get(c, F.lit(i))).alias(f"{c}{i}") for i in range(len(alive)) for c, f in (("loss", F.avg), ("hit", F.avg))]
        found = {r["fold"]: r for r in state.groupBy("fold").agg(*each).collect()}  # a row a fold
        kept, passes = list(range(len(alive))), passes + 2
        mean, by_fold = [], []
        for i, c in enumerate(alive):
            loss, hit = (np.array([found[f][f"{x}{i}"] for f in range(n_folds) if fit_sizes[f]]) for x in ("loss", "hit"))
            mean.append(loss.mean())
            by_fold.append(loss)
            table.append([c, done, float(loss.mean()), float(loss.std()), float(hit.mean()), float(hit.std())])
            grown[c] = done
        if done in rungs[:-1]:
            order = sorted(range(len(alive)), key=lambda i: (mean[i], i))
            size = math.ceil(len(alive) / eta)
            beyond = {i: by_fold[i] - by_fold[order[size - 1]] for i in order[size:]}
            near = [i for i, d in beyond.items() if d.mean() < sure * d.std(ddof=min(1, len(d) - 1)) / math.sqrt(len(d))]
            kept = sorted(order[:size] + near)
    last = [r for r in table if grown[r[0]] == rungs[-1]]
    best = min(last, key=lambda r: (r[2], r[0], r[1]))
    out = [(json.dumps(candidates[r[0]], sort_keys=True), *r[1:], r is best) for r in table]
    return Search({**candidates[best[0]], "rounds": best[1]}, rows.sparkSession.createDataFrame(out, SCORES), passes, grown)


def _start(edges: list, starts: np.ndarray, n: int):
    def run(batches):
        for b in batches:
            x = boosting._binned(_matrix(b.column(0), len(edges)), [np.array(e) for e in edges])
            empty = _lists(np.zeros((b.num_rows, 1)), pa.float64())
            flat = np.tile(starts.ravel(), (b.num_rows, n))
            yield pa.RecordBatch.from_arrays([_lists(x.astype(np.int32), pa.int32()), b.column(1), b.column(2), _lists(flat, pa.float64()), empty, empty], names=["bins", "label", "fold", "scores", "loss", "hit"])

    return run


def fit_best(rows: DataFrame, classes: int, n_features: int, search: Search, features: str = "features", label: str = "label", bins: int = BINS) -> Boosted:
    """The search's best, fitted on all rows."""
    return boosting.fit_boosted(rows, classes, n_features, features, label, bins=bins, **search.best)
