import random

from glossa.llm import topk


def vector(bits):
    return [1.0 if b else -1.0 for b in bits]


def test_nulls_ties_repeats_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 4)
    rng = random.Random(3)
    some = {i: [rng.random() < 0.5 for _ in range(64)] for i in range(200)}
    some[7] = some[5]  # a tie
    rows = [(i, vector(b)) for i, b in some.items()] + [(5, vector(some[5])), (500, None), (501, [1.0]), (502, [None] * 64), (None, vector(some[1]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS code", "3 AS rank", "4 AS query_id", "5 AS distance")
    asked = df.filter("vec_id IN (5, 100, 500)")  # 5 twice
    got = {}
    for r in topk.search(df, asked, k=6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["vec_id"]))
    assert got.keys() == {5, 100}
    held = [*some.items(), (5, some[5])]
    for q, found in got.items():
        want = sorted((sum(x != y for x, y in zip(b, some[q], strict=True)), i) for i, b in held)[:6]
        assert sorted(found) == [(n + 1, *w) for n, w in enumerate(want)]


def test_one_id_with_two_codes_and_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, vector([True] * 64)), (1, vector([False] * 64))], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search(df, df, k=10).collect())
    assert got == [(1, 1, 1, 0), (1, 1, 1, 0), (1, 2, 1, 64), (1, 2, 1, 64)]
    assert topk.search(df.limit(0), df).count() == topk.search(df, df.limit(0)).count() == 0


def test_hot_bucket_and_far_queries(spark):
    rng = random.Random(4)
    same, other = [rng.random() < 0.5 for _ in range(64)], [rng.random() < 0.5 for _ in range(64)]
    rows = [(i, vector(same)) for i in range(3000)] + [(5000, vector(other)), (5001, vector([not b for b in same]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.search(df, df.filter("vec_id IN (7, 5000, 5001)"), k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["vec_id"]))
    apart = sum(x != y for x, y in zip(same, other, strict=True))
    assert sorted(got[7]) == [(1, 0, 0), (2, 0, 1), (3, 0, 2)]
    assert sorted(got[5000])[0] == (1, 0, 5000) and sorted(got[5000])[1][1] == min(apart, 64 - apart)
    assert sorted(got[5001])[0] == (1, 0, 5001) and sorted(got[5001])[1][1] == min(64, 64 - apart)
