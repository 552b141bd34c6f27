"""Randomised and reweighted trees against plain versions over all rows, and on rows held out."""

import duckdb
import numpy as np
import pytest
from test_boosting import points

from glossa.operators import forests as fo


def arrays(df):
    rows = df.collect()
    return np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows])


def gini(y, w, k=3):
    c = np.bincount(y, w, k)
    return (c * c).sum() / max(c.sum(), 1e-300)


def test_sums_equal_sql(spark):
    ready, _ = fo._prepared(points(spark), 3, 3, "features", "label", 8)
    ready = ready.selectExpr("bins", "label", "double(1 + bins[0]) AS weight").repartition(4)
    tree = fo.ClassTree(2, classes=3, drawn=np.array([[2, 0], [1, 2], [0, 1], *[[0, 1]] * 4]))
    tree.feature[0], tree.split[0] = 0, 3
    con = duckdb.connect()
    con.register("s", ready.toArrow())
    got = {(r["node"], r["slot"], r["bin"], r["class"]): (r["w"], r["n"]) for r in fo.class_sums(ready, [tree], 1, 8).collect()}
    sql = """SELECT node, slot, bins[CASE WHEN node = 1 THEN [2, 3] ELSE [1, 2] END[slot + 1]], label, sum(weight), count(*)
      FROM (SELECT *, CASE WHEN bins[1] > 3 THEN 2 ELSE 1 END AS node FROM s), range(2) AS r(slot) GROUP BY ALL"""
    want = {r[:4]: r[4:] for r in con.execute(sql).fetchall()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(tuple(map(float, want[x]))) for x in want)


def test_every_node_of_a_forest_takes_the_best_of_its_random_cuts(spark):
    rows = points(spark)
    model = fo.fit_extra_trees(rows, 3, 3, trees=3, depth=3, tried=2, least=5, bins=16, seed=4)
    x, y = arrays(rows)
    bins = fo._binned(x, [np.array(e) for e in model.edges])
    for i, t in enumerate(model.trees):
        inside = {0: np.ones(len(y), bool)}
        for at in range(7):
            if at not in inside:
                assert t.feature[at] == -1
                continue
            m = inside[at]
            assert t.value[at] == pytest.approx(np.bincount(y[m], minlength=3))
            rng, best = np.random.default_rng([4, i, at, 1]), (1e-9, -1, 0)
            for f in t.drawn[at]:
                low, high = bins[m, f].min(), bins[m, f].max()
                if low == high:
                    continue
                cut = int(rng.integers(low, high))
                left, right = m & (bins[:, f] <= cut), m & (bins[:, f] > cut)
                gain = gini(y[left], np.ones(left.sum())) + gini(y[right], np.ones(right.sum())) - gini(y[m], np.ones(m.sum()))
                if min(left.sum(), right.sum()) >= 5 and gain > best[0]:
                    best = (gain, f, cut)
            assert t.feature[at] == best[1] and (best[1] < 0 or t.split[at] == best[2])
            if best[1] >= 0:
                inside[2 * at + 1], inside[2 * at + 2] = m & (bins[:, best[1]] <= best[2]), m & (bins[:, best[1]] > best[2])
    grouped = fo.CELLS
    try:
        fo.CELLS = 1  # a tree a pass
        again = fo.fit_extra_trees(rows.repartition(5), 3, 3, trees=3, depth=3, tried=2, least=5, bins=16, seed=4)
    finally:
        fo.CELLS = grouped
    assert all((a.feature == b.feature).all() and (a.split == b.split).all() for a, b in zip(model.trees, again.trees, strict=True))


def test_reweighted_stumps_equal_a_plain_version(spark):
    rows = points(spark)
    model = fo.fit_reweighted(rows, 3, 3, rounds=5, depth=1, bins=8)
    x, y = arrays(rows)
    bins, w = fo._binned(x, [np.array(e) for e in model.edges]), np.ones(len(y))
    for tree, say in zip(model.trees, model.say, strict=True):
        best = max((round(gini(y[left], w[left]) + gini(y[~left], w[~left]), 9), -f, -c) for f in range(3) for c in range(8) if (left := bins[:, f] <= c).any() and not left.all())
        assert (tree.feature[0], tree.split[0]) == (-best[1], -best[2])
        left = bins[:, tree.feature[0]] <= tree.split[0]
        told = np.where(left, np.bincount(y[left], w[left], 3).argmax(), np.bincount(y[~left], w[~left], 3).argmax())
        error = w[told != y].sum() / w.sum()
        assert say == pytest.approx(np.log((1 - error) / error) + np.log(2))
        w = w * np.where(told != y, np.exp(say), 1)
        w /= w.sum()
    assert len(model.trees) == 5


def test_both_learn_what_a_single_tree_does_not(spark):
    train, held = points(spark), points(spark, 600, 2)
    right = lambda m: m.transform(held).filter("prediction = label").count() / 600
    one = right(fo.fit_reweighted(train, 3, 3, rounds=1, depth=2))
    assert right(fo.fit_reweighted(train, 3, 3, rounds=12, depth=2)) > max(0.75, one + 0.1)
    assert right(fo.fit_extra_trees(train, 3, 3, trees=20, depth=6, tried=3)) > max(0.75, one + 0.1)


def test_nulls_odd_labels_no_rows_and_no_errors(spark):
    rows = [(1, [1.0, None, 2.0], 0), (2, None, 1), (3, [float("nan"), 1.0, 1.0], 1), (4, [1.0, 1.0, 1.0], 7), (5, [0.0, 0.0, 0.0], None), (6, [], 0)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    for fit in (fo.fit_extra_trees, fo.fit_reweighted):
        assert [sum(r["probability"]) for r in fit(df, 2, 3, **({"rounds": 2} if fit is fo.fit_reweighted else {"trees": 2, "depth": 2})).transform(df).collect()] == pytest.approx([1.0] * 6)
        empty = fit(df.limit(0), 2, 3, depth=1)
        assert empty.transform(df).first()["probability"] == [0.5, 0.5]
    sure = spark.createDataFrame([([float(i)], int(i > 4)) for i in range(10)], "features array<double>, label int")
    model = fo.fit_reweighted(sure, 2, 1, rounds=5)
    assert len(model.trees) == 1 and model.transform(sure).filter("prediction = label").count() == 10
    same = fo.fit_reweighted(spark.createDataFrame([([1.0], 0), ([1.0], 1)], "features array<double>, label int"), 2, 1)
    assert len(same.trees) == 1 and same.say == [1.0]
