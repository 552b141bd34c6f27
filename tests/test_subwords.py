"""N-gram buckets and means of words that a vector table lacks, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import subwords as sw

WORDS = ["get", "a", "naïve", "<", "", "日本語", "where", "𝔘nicode", "x" * 3000, None]


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = ((h ^ ((b - 256 if b > 127 else b) & 0xFFFFFFFF)) * 16777619) % 2**32
    return h


def grams(word, a, b):
    if not word:
        return []
    m = f"<{word}>"
    return [m[i : i + n] for n in range(a, b + 1) for i in range(len(m) - n + 1) if m[i : i + n] not in ("<", ">")]


def test_buckets(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "word string")
    for a, b in ((3, 6), (1, 2)):
        got = {(r["word"], r["bucket"]): r["n"] for r in sw.word_buckets(df, 97, a, b).collect()}
        want = {}
        for w in WORDS:
            for g in grams(w, a, b):
                want[w, fnv(g) % 97] = want.get((w, fnv(g) % 97), 0) + 1
        assert got == want
    # published values of the hash for ASCII text
    assert [r[0] for r in spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "t string").select(sw.fnv1a("t")).collect()] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968, None]


def test_fetch(spark):
    rng = np.random.default_rng(4)
    table = {i: rng.normal(size=4).astype("float32") for i in range(97) if i % 5}
    t = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in table.items()], "bucket long, vec array<float>")
    vectors = spark.createDataFrame([("get", [1.0, 2.0, 3.0, 4.0]), ("where", None), ("unused", [0.0] * 4)], "word string, vec array<float>")
    rows = [(i, w) for i, w in enumerate(WORDS * 2)]
    got = sw.fetch_with_subwords(spark.createDataFrame(rows, "id int, word string"), vectors, t, 4, 97).select("id", "word", "vec").collect()
    assert sorted(r["id"] for r in got) == list(range(len(rows)))
    for r in got:
        own = [table[fnv(g) % 97] for g in grams(r["word"], 3, 6) if fnv(g) % 97 in table]
        want = [1, 2, 3, 4] if r["word"] == "get" else np.mean(own, axis=0, dtype=float) if own else [0] * 4
        assert r["vec"] == pytest.approx(list(want), abs=1e-5), r["word"]


def test_empty_tables(spark):
    words = spark.createDataFrame([("get",)], "word string")
    none = spark.createDataFrame([], "bucket long, vec array<float>")
    assert sw.subword_vectors(words, none, 97).count() == 0
    out = sw.fetch_with_subwords(words, none.select(F.lit("x").alias("word"), "vec"), none, 3, 97).collect()
    assert [(r["word"], r["vec"]) for r in out] == [("get", [0.0, 0.0, 0.0])]
