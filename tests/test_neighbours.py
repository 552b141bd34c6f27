"""Neighbours against all distances: many leaves, copies, ties, hot leaves in blocks, too few rows, and odd vectors."""

import numpy as np
import pytest

from glossa.operators import neighbours as nb


def brute(x, keys, q, k):
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    return [[(int(keys[j]), d[i, j]) for j in np.lexsort((keys, d[i]))[:k]] for i in range(len(q))]


def frame(spark, x, first=0):
    return spark.createDataFrame([(i + first, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "id long, v array<double>, label int")


@pytest.mark.parametrize(("width", "leaf"), [(3, 20), (8, 50), (2, 1000)])
def test_equal_to_all_distances(spark, monkeypatch, width, leaf):
    monkeypatch.setattr(nb, "BLOCK", 64)
    rng = np.random.default_rng(width)
    x = rng.normal(size=(900, width))
    x[:300] = x[0]  # a third are copies: one leaf of several blocks, and ties by key
    x[300:400] = np.round(x[300:400])  # equal distances
    q = np.concatenate([x[290:420], rng.normal(size=(20, width)) * 4])
    index = nb.build_index(frame(spark, x), "id", "v", "label", width, leaf=leaf)
    assert index.tree.leaves == max(1, min(2 ** int(np.ceil(np.log2(900 / leaf))), 2**width))
    rows = nb.nearest(index, frame(spark, q, 5000), "id", "v", 5).orderBy("query", "rank").collect()
    want = brute(x, np.arange(900), q, 5)
    assert len(rows) == 5 * len(q)
    for i, w in enumerate(want):
        got = rows[5 * i : 5 * i + 5]
        assert [r["key"] for r in got] == [key for key, _ in w] and [r["distance"] for r in got] == pytest.approx([d for _, d in w])
        assert [r["label"] for r in got] == [key % 3 for key, _ in w] and [r["rank"] for r in got] == [1, 2, 3, 4, 5]


def test_leaves_are_at_least_as_far_as_told(spark):
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(2000, 5)), rng.normal(size=(100, 5))
    tree = nb.projections(x, 4, 1)
    leaf, least = tree.leaf(x), tree.distances(q)
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    assert (least[:, leaf] <= d + 1e-12).all() and (least[np.arange(100), tree.leaf(q)] == 0).all()
    assert np.bincount(leaf, minlength=16).min() > 100


def test_near_clusters_rule_out_other_leaves():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(64, 4)) * 50, 40, axis=0) + rng.normal(size=(2560, 4)) * 0.1
    tree = nb.projections(x, 4, 1)
    assert (tree.distances(x) <= 1).sum(axis=1).mean() < 3  # of 16 leaves


def test_few_rows_odd_vectors_and_no_rows(spark):
    rows = [(1, [0.0, 0.0], 1), (2, [1.0, 0.0], None), (3, None, 1), (4, [1.0], 1), (5, [1.0, None], 1), (6, [float("nan"), 0.0], 1), (None, [0.0, 0.0], 1), (7, [float("inf"), 0.0], 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    index = nb.build_index(df, "id", "v", "label", 2)
    found = nb.nearest(index, df, "id", "v", 3)
    assert sorted((r["query"], r["rank"], r["key"]) for r in found.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)]
    assert sorted(map(tuple, nb.told(found).collect())) == [(1, 1), (2, 1)]
    empty = nb.build_index(df.limit(0), "id", "v", "label", 2)
    assert nb.nearest(empty, df, "id", "v", 3).count() == 0
    assert nb.nearest(index, df.limit(0), "id", "v", 3).count() == 0


def test_votes_that_are_equal_go_to_the_least(spark):
    found = spark.createDataFrame([(1, 2), (1, 1), (1, 2), (1, 1), (1, None), (2, 5)], "query long, label int")
    assert sorted(map(tuple, nb.told(found).collect())) == [(1, 1), (2, 5)]
