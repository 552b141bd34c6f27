"""The search that shares passes, against models of one candidate and fold at a time, and against the table of all."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import boosting, halving

GRID = {"depth": [1, 2], "rate": [0.05, 0.5]}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 6, (600, 3))
    y = np.where(rng.random(600) < 0.1, rng.integers(0, 3, 600), (x[:, 0] > 2) + ((x[:, 0] > 2) & (x[:, 1] > 3)))
    return spark.createDataFrame([([float(v) for v in a], int(b), i % 3) for i, (a, b) in enumerate(zip(x, y, strict=True))], "features array<double>, label int, fold int").repartition(4)


def test_scores_equal_models_of_one_fold(spark, rows):
    found = halving.search_boosted(rows, 3, 3, GRID, [2], n_folds=3, eta=1)
    table = {(json.loads(r["params"])["depth"], json.loads(r["params"])["rate"], r["rounds"]): r for r in found.table.collect()}
    assert len(table) == 8
    for depth, rate, rounds in ((1, 0.05, 1), (2, 0.5, 2)):
        losses, hits = [], []
        for f in range(3):
            model = boosting.fit_boosted(rows.filter(F.col("fold") != f), 3, 3, rounds=rounds, depth=depth, rate=rate)
            held = rows.filter(F.col("fold") == f).collect()
            p = boosting._softmax(model.scores(np.array([r["features"] for r in held])))
            y = np.array([r["label"] for r in held])
            losses.append(-np.log(p[np.arange(len(y)), y]).mean())
            hits.append((p.argmax(axis=1) == y).mean())
        r = table[depth, rate, rounds]
        assert r["mean_loss"] == pytest.approx(np.mean(losses)) and r["std_loss"] == pytest.approx(np.std(losses))
        assert r["mean_accuracy"] == pytest.approx(np.mean(hits)) and r["std_accuracy"] == pytest.approx(np.std(hits))


def test_halving_finds_the_winner_in_fewer_passes(spark, rows):
    whole = halving.search_boosted(rows, 3, 3, GRID, [4], n_folds=3, eta=1)
    half = halving.search_boosted(rows, 3, 3, GRID, [1, 2, 4], n_folds=3)
    assert half.best == whole.best
    # the two of the higher rate are within the folds' noise of each other, so that both reach the end
    assert sorted(half.grown) == [1, 1, 4, 4] and whole.grown == [4] * 4
    strict = halving.search_boosted(rows, 3, 3, GRID, [1, 2, 4], n_folds=3, sure=0)
    assert sorted(strict.grown) == [1, 1, 2, 4] and strict.best["rate"] == 0.5
    alone = 4 * 3 * 4 * 3  # candidates x folds x rounds x levels, of depth 2
    assert strict.passes == half.passes == whole.passes < alone / 4  # what goes is work in a pass
    assert half.table.filter("best").count() == 1 and half.table.count() == sum(half.grown)
    assert len(halving.fit_best(rows, 3, 3, half).rounds) == half.best["rounds"]


def test_edges(spark, rows):
    odd = rows.unionByName(spark.createDataFrame([([None, float("nan"), 1.0], 1, 0), (None, 2, 1), ([1.0, 2.0, 3.0], 9, 0), ([1.0, 2.0, 3.0], None, 0), ([1.0, 2.0, 3.0], 1, None)], rows.schema))
    out = halving.search_boosted(odd.withColumn("bins", F.lit(1)), 3, 3, {"depth": [1]}, [1], n_folds=3)
    assert out.table.count() == 1
    with pytest.raises(ValueError, match="no rows"):
        halving.search_boosted(rows.limit(0), 3, 3, GRID, [1], n_folds=3)
    with pytest.raises(ValueError, match="rungs"):
        halving.search_boosted(rows, 3, 3, GRID, [2, 1])
    with pytest.raises(ValueError, match="no parameter"):
        halving.search_boosted(rows, 3, 3, {"speed": [1]}, [1])
