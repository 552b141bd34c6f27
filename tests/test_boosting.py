"""Histograms against DuckDB, splits against exhaustive search, and several classes against one against the rest."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import boosting as gb
from glossa.operators import models


def points(spark, n=900, seed=1):
    """Three classes by the angle of two features, which no one class's single split tells apart; a third feature says nothing."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    label = ((np.arctan2(x[:, 1], x[:, 0]) + np.pi) / (2 * np.pi) * 6).astype(int) % 3
    return spark.createDataFrame([(i, [float(v) for v in r], int(y)) for i, (r, y) in enumerate(zip(x, label, strict=True))], "id long, features array<double>, label int")


def state(spark, rows, edges, n=3):
    made = rows.select("features", "label").mapInArrow(gb._binner(edges, np.log([0.5, 0.3, 0.2])), "bins array<int>, label int, scores array<double>")
    return made.repartition(4)


def test_histograms_equal_sql_at_two_levels(spark):
    rows = points(spark)
    edges = gb.quantile_edges(rows, "features", 3, 8)
    binned = state(spark, rows, edges)
    trees = [gb.Tree(2) for _ in range(3)]
    for k, t in enumerate(trees):
        t.feature[0], t.split[0] = k, 3
    con = duckdb.connect()
    con.register("s", binned.toArrow())
    p = {0: 0.5, 1: 0.3, 2: 0.2}
    for level in (0, 1):
        got = {(r["class"], r["node"], r["feature"], r["bin"]): (r["g"], r["h"], r["n"]) for r in gb.histograms(binned, trees, level, 3, 8).collect()}
        want = {}
        for k in range(3):
            node = "0" if level == 0 else f"CASE WHEN bins[{k + 1}] > 3 THEN 2 ELSE 1 END"
            sql = f"SELECT {node}, f, bins[f + 1], sum({p[k]} - (label = {k})::INT), sum({p[k] * (1 - p[k])}), count(*) FROM s, range(3) AS r(f) GROUP BY ALL"
            want |= {(k, *r[:3]): r[3:] for r in con.execute(sql).fetchall()}
        assert got.keys() == want.keys()
        for x in want:
            assert got[x] == pytest.approx(tuple(map(float, want[x]))), x


def test_first_splits_equal_exhaustive_search(spark):
    rows = points(spark)
    model = gb.fit_boosted(rows, 3, 3, rounds=1, depth=1, bins=16)
    x = np.array([r["features"] for r in rows.collect()])
    y = np.array([r["label"] for r in rows.collect()])
    p = np.exp(model.start)
    for k, tree in enumerate(model.rounds[0]):
        g, h = p[k] - (y == k), np.full(len(y), p[k] * (1 - p[k]))
        of = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)  # noqa: B023, E731
        best = max((of(x[:, f] <= e) + of(x[:, f] > e), -f, -b) for f in range(3) for b, e in enumerate(model.edges[f]) if min((x[:, f] <= e).sum(), (x[:, f] > e).sum()) >= 5)
        assert (tree.feature[0], tree.split[0]) == (-best[1], -best[2])
        left = x[:, tree.feature[0]] <= model.edges[tree.feature[0]][tree.split[0]]
        assert tree.value[1] == pytest.approx(-0.3 * g[left].sum() / (h[left].sum() + 1))


def test_beats_one_against_the_rest_and_scores_add_up(spark):
    train, held = points(spark), points(spark, 600, 2)
    model = gb.fit_boosted(train, 3, 3, rounds=8, depth=3)
    out = model.transform(held).collect()
    right = np.mean([r["prediction"] == r["label"] for r in out])
    other = models.fit_tagger(train.withColumn("vec", F.col("features")), "gbt_ovr", params={"maxIter": 8, "maxDepth": 3})
    rest = other.transform(held.withColumn("vec", F.col("features")))
    assert right > 0.85 and right >= rest.filter("prediction = label").count() / 600 - 0.01
    assert all(sum(r["probability"]) == pytest.approx(1) for r in out)


def test_nulls_odd_labels_and_no_rows(spark):
    rows = [(1, [1.0, None, 2.0], 0), (2, None, 1), (3, [float("nan"), 1.0, 1.0], 1), (4, [1.0, 1.0, 1.0], 7), (5, [0.0, 0.0, 0.0], None), (6, [], 0)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    model = gb.fit_boosted(df, 2, 3, rounds=2, depth=1, least=1)
    assert [len(r["probability"]) for r in model.transform(df.filter("size(features) = 3")).collect()] == [2] * 4
    empty = gb.fit_boosted(df.limit(0), 2, 3, rounds=1, depth=1)
    assert empty.transform(df.filter("id = 4")).first()["prediction"] == 0
