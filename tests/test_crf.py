"""The linear chain against finite differences, all paths, and counted transitions on held-out sequences."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import crf, models


def random_chain(rng, n_tags=3, slots=7):
    return crf.Chain(n_tags, slots, rng.normal(size=slots * n_tags + n_tags * (n_tags + 2)))


def sequences(rng, n, slots=7, n_tags=3):
    out = []
    for _ in range(n):
        size = int(rng.integers(0, 6))
        out.append(([[int(x) for x in rng.choice(slots, int(rng.integers(1, 4)), replace=False)] for _ in range(size)], [int(x) for x in rng.integers(0, n_tags, size)]))
    return out


def path_score(chain, features, path):
    own, trans, first, last = chain._parts()
    score = sum(own[f, t] for fs, t in zip(features, path, strict=True) for f in fs) + sum(trans[a, b] for a, b in itertools.pairwise(path))
    return score + (first[path[0]] + last[path[-1]] if path else 0)


def test_loss_and_gradient_equal_all_paths_and_differences(spark):
    rng = np.random.default_rng(2)
    chain, rows = random_chain(rng), sequences(rng, 30)
    df = spark.createDataFrame(rows, "features array<array<int>>, tags array<int>").repartition(4)
    loss, grad = crf.loss_and_gradient(df, chain)
    want = 0
    for f, y in rows:
        if f:
            want += np.log(sum(np.exp(path_score(chain, f, p)) for p in itertools.product(range(3), repeat=len(f)))) - path_score(chain, f, y)
    assert loss == pytest.approx(want)
    f, y = [r[0] for r in rows], [r[1] for r in rows]
    for i in range(len(grad)):
        near = [crf.Chain(3, 7, chain.weights + d * np.eye(len(grad))[i]).loss(f, y)[0] for d in (1e-5, -1e-5)]
        assert grad[i] == pytest.approx((near[0] - near[1]) / 2e-5, abs=1e-5), i


def test_marginals_and_best_equal_all_paths(spark):
    rng = np.random.default_rng(3)
    chain, rows = random_chain(rng), sequences(rng, 12)
    df = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(rows)] + [(99, None)], "i int, features array<array<int>>")
    got = {r["i"]: (r["m"], r["b"]) for r in df.select("i", chain.marginals(F.col("features")).alias("m"), chain.best(F.col("features")).alias("b")).collect()}
    assert got[99] == ([], [])
    for i, (f, _) in enumerate(rows):
        paths = list(itertools.product(range(3), repeat=len(f)))
        p = np.exp([path_score(chain, f, x) for x in paths])
        for t in range(len(f)):
            want = [sum(p[j] for j, x in enumerate(paths) if x[t] == k) / p.sum() for k in range(3)]
            assert got[i][0][t] == pytest.approx(want) and sum(got[i][0][t]) == pytest.approx(1)
        assert not f or tuple(got[i][1]) == paths[int(p.argmax())]


def hidden_sequences(rng, n):
    """Tags that follow each other by rule; a word tells its tag two times of three, so that neighbours are needed."""
    out = []
    for i in range(n):
        tags = [int(rng.integers(0, 3))]
        while len(tags) < 8:
            tags.append((tags[-1] + (1 if rng.random() < 0.9 else 2)) % 3)
        out.append((i, [[t if rng.random() < 0.67 else int(rng.integers(0, 3))] for t in tags], tags))
    return out


def test_training_beats_counted_transitions_on_held_out_sequences(spark, tmp_path):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(hidden_sequences(rng, 400), "i long, features array<array<int>>, tags array<int>").repartition(3)
    train, held = df.filter("i < 300"), df.filter("i >= 300").orderBy("i").collect()
    odd = spark.createDataFrame([(-1, [[0]], [7]), (-2, [[0]], None), (-3, [[0], [1]], [0])], df.schema)
    chain, losses = crf.fit_chain(train.unionByName(odd), 3, slots=5, steps=25)
    assert all(b <= a for a, b in itertools.pairwise(losses)) and losses[-1] < 0.8 * losses[0]
    crf.save_chain(spark, chain, f"{tmp_path}/chain")
    again = crf.load_chain(spark, f"{tmp_path}/chain")
    found = [r[0] for r in df.filter("i >= 300").orderBy("i").select(again.best(F.col("features"))).collect()]
    gold = np.array([r["tags"] for r in held])
    # the words' own counts, alone and with counted transitions
    counts = np.ones((3, 3))
    for r in train.collect():
        for f, t in zip(r["features"], r["tags"], strict=True):
            counts[f[0], t] += 1
    own = np.log(counts / counts.sum(axis=1, keepdims=True))
    trans = models.fit_transitions(train.select(F.transform("tags", lambda t: t.cast("string")).alias("tags")), labels=["0", "1", "2"])
    e = spark.createDataFrame([(r["i"], [own[f[0]].tolist() for f in r["features"]]) for r in held], "i long, e array<array<double>>").orderBy("i")
    alone = np.array([[int(own[f[0]].argmax()) for f in r["features"]] for r in held])
    counted = np.array([r[0] for r in e.select(models.viterbi(3, trans)(F.col("e"))).collect()])
    right = [(np.array(x) == gold).mean() for x in (found, counted, alone)]
    assert right[0] > right[2] + 0.05 and right[0] >= right[1] - 0.005


def test_features_tell_words_and_places_apart(spark):
    df = spark.createDataFrame([(["get", "Name", "get"], "CLASS"), ([], "CLASS")], "words array<string>, context string")
    got = [r[0] for r in df.select(crf.token_features(F.col("words"), F.col("context"))).collect()]
    assert got[1] == [] and len(got[0]) == 3 and got[0][0] != got[0][2] and all(0 <= x < crf.SLOTS for t in got[0] for x in t)


def test_equal_sequences_are_read_once_with_their_number(spark, monkeypatch):
    rng = np.random.default_rng(5)
    chain, rows = random_chain(rng), [r for r in sequences(rng, 12) if r[0]]
    schema = "features array<array<int>>, tags array<int>"
    many = spark.createDataFrame([r for i, r in enumerate(rows) for _ in range(i + 1)], schema)
    once = spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], f"{schema}, times long")
    (a, ga), (b, gb) = crf.loss_and_gradient(many, chain), crf.loss_and_gradient(once, chain)
    assert a == pytest.approx(b) and ga == pytest.approx(gb, abs=1e-9)
    seen = []
    monkeypatch.setattr(crf, "loss_and_gradient", lambda df, c: seen.append(df.count()) or (0.0, np.zeros_like(c.weights)))
    crf.fit_chain(many, 3, 7, steps=1)
    assert seen == [len({str(r) for r in rows})]


def test_a_row_with_times_is_as_many_sequences(spark):
    rows = [r for r in sequences(np.random.default_rng(8), 12) if r[0]]
    schema = "features array<array<int>>, tags array<int>"
    many = spark.createDataFrame([r for i, r in enumerate(rows) for _ in range(i % 3 + 1)], schema)
    once = spark.createDataFrame([(*r, i % 3 + 1) for i, r in enumerate(rows)], f"{schema}, times long")
    (a, la), (b, lb) = crf.fit_chain(many, 3, 7, steps=3), crf.fit_chain(once.unionByName(once.limit(0)), 3, 7, steps=3)
    assert la == pytest.approx(lb) and a.weights == pytest.approx(b.weights, abs=1e-9)


def test_best_paths_are_one_step_of_python(spark):
    chain = random_chain(np.random.default_rng(6))
    df = spark.createDataFrame([([[0, 1], [], [2]],), ([],), (None,), ([[3]],)], "features array<array<int>>")
    out = df.select(chain.best(F.col("features")).alias("b"))
    assert [len(r["b"]) for r in out.collect()] == [3, 0, 0, 1]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "array<double>" not in plan and plan.count("EvalPython") == 1 and "run(run(" not in plan.replace("#", "")
    assert "ArrowEvalPython [run(features" in plan
