"""The beam against all paths, mixing against plain code, and tags that no token's own features determine."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import perceptron as sp


def random_tagger(rng, beam, n_tags=3, slots=6):
    return sp.BeamTagger(n_tags, slots, beam, rng.normal(size=(slots, n_tags)), rng.normal(size=(n_tags + 1, n_tags + 1, n_tags)))


def test_a_wide_beam_equals_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(60):
        tagger = random_tagger(rng, 9)
        features = [[int(x) for x in rng.choice(6, int(rng.integers(1, 4)), replace=False)] for _ in range(int(rng.integers(0, 6)))]
        best = max(itertools.product(range(3), repeat=len(features)), key=lambda p: tagger.score(features, list(p)))
        assert tagger.decode(features) == list(best)
        narrow = sp.BeamTagger(3, 6, 2, tagger.own, tagger.chain).decode(features)
        assert len(narrow) == len(features) and tagger.score(features, narrow) <= tagger.score(features, list(best)) + 1e-9


def test_learning_stops_where_the_beam_loses_gold():
    tagger = sp.BeamTagger(3, 6, 1)
    tagger.own[0, 0] = 5
    assert tagger.decode([[0], [1], [1]], gold=[0, 1, 0]) == [0, 0]  # of equal scores the first tag stays


def agreeing(rng, n):
    """Three kinds of names in which a word's tag depends on the tags of the two words before: words don't tell tags 1 and 2 apart."""
    out = []
    for i in range(n):
        tags = [int(rng.integers(0, 3)), int(rng.integers(0, 3))]
        while len(tags) < 7:
            tags.append((tags[-1] + tags[-2] + 1) % 3)
        words = [[0 if t == 0 else 1] if rng.random() < 0.9 else [2] for t in tags]
        words[0], words[1] = [3 + tags[0]], [3 + tags[1]]
        out.append((i, words, tags))
    return out


def test_context_decides_on_held_out_sequences(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(agreeing(rng, 400), "i long, features array<array<int>>, tags array<int>").repartition(4)
    odd = spark.createDataFrame([(-1, [[0]], [9]), (-2, [[0]], None), (-3, [[0], [1]], [0])], df.schema)
    tagger = sp.fit_beam_tagger(df.filter("i < 300").unionByName(odd), 3, slots=8, rounds=4)
    rows = df.filter("i >= 300").select("tags", tagger.best(F.col("features")).alias("found")).collect()
    right = np.mean([x == y for r in rows for x, y in zip(r["tags"], r["found"], strict=True)])
    # what the best tag for each word alone can reach
    alone = np.mean([x == y for r in df.filter("i >= 300").collect() for x, y in zip(r["tags"], [{0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 5: 2}[f[0]] for f in r["features"]], strict=True)])
    assert right > 0.97 and alone < 0.8
    assert spark.createDataFrame([(None,)], "f array<array<int>>").select(tagger.best(F.col("f"))).first()[0] == []


def test_a_round_mixes_what_tasks_learn(spark):
    rng = np.random.default_rng(3)
    rows, start = agreeing(rng, 40), random_tagger(rng, 9, slots=8)
    df = spark.createDataFrame(rows, "i long, features array<array<int>>, tags array<int>").repartition(3, "i")
    parts = [[(r["features"], r["tags"]) for r in p] for p in df.rdd.glom().collect() if p]
    learned, sums = [], []
    for p in parts:
        tagger, total = sp._Learner(start), 0
        for f, y in p:
            tagger.learn(f, y)
            total = total + np.concatenate((tagger.tagger.own.ravel(), tagger.tagger.chain.ravel()))
        learned.append(np.concatenate((tagger.tagger.own.ravel(), tagger.tagger.chain.ravel())))
        sums.append(total)
    mixed, total, seen = sp.one_round(df, start)
    assert seen == 40
    assert np.concatenate((mixed.own.ravel(), mixed.chain.ravel())) == pytest.approx(np.mean(learned, axis=0))
    assert total == pytest.approx(np.sum(sums, axis=0))
