"""Least-cost segmentation against every way to cut a word."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glossa.operators import segment as sg

SF = "/root/testdata/sf0.001"


def brute_force(word, counts, unknown=sg.UNKNOWN):
    """(pieces, cost) by trying every way to cut a word."""
    total, best = math.log(sum(counts.values()) or 1.0), None
    price = {p: total - math.log(n) for p, n in counts.items()}
    for cuts in range(1 << max(len(word) - 1, 0)):
        ends = [i + 1 for i in range(len(word) - 1) if cuts >> i & 1] + [len(word)]
        pieces = [word[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if word else []
        if any(p not in counts and len(p) > 1 for p in pieces):
            continue
        cost = 0.0
        for p in reversed(pieces):
            cost = min(price.get(p, math.inf), total + unknown if len(p) == 1 else math.inf) + cost
        found = (cost, len(pieces), tuple(-np.cumsum([len(p.encode()) for p in pieces])))
        if best is None or found < best[0]:
            best = (found, pieces)
    return best[1], best[0][0]


def test_the_trie_finds_every_key_that_begins_somewhere():
    rng = np.random.default_rng(1)
    keys = sorted({bytes(rng.integers(97, 100, int(rng.integers(1, 6))).tolist()) for _ in range(120)} | {"é".encode(), "éa".encode(), b"\xff\x00"})
    trie = sg.Trie(keys)
    for _ in range(300):
        text = bytes(rng.integers(97, 101, int(rng.integers(0, 9))).tolist()) + "éab".encode()
        for i in range(len(text)):
            assert trie.ends(text, i) == sorted((i + len(k), n) for n, k in enumerate(keys) if text[i:].startswith(k))
    assert sg.Trie([]).ends(b"a", 0) == []


@pytest.mark.parametrize("seed", range(4))
def test_equals_every_way_to_cut(seed):
    rng = np.random.default_rng(seed)
    letters = "abcé"
    word = lambda n: "".join(rng.choice(list(letters), n))
    counts = {word(int(rng.integers(1, 5))): float(rng.integers(1, 50)) for _ in range(25)}
    dictionary = sg.Dictionary.of(counts)
    for _ in range(60):
        w = word(int(rng.integers(0, 11)))
        assert dictionary.segment(w) == brute_force(w, counts)


def test_identifiers_keep_their_spelling_and_order(spark):
    counts = spark.createDataFrame([("get", 900), ("user", 500), ("name", 700), ("names", 90), ("username", 1), ("a", 10**6), (None, 3), ("no", 0)], "word string, cnt long")
    dictionary = sg.dictionary_of(counts)
    rows = [(1, ["getusername", "X", "USERNAME"]), (2, ["Getnames", "getUser", "getqqq", "get"]), (3, []), (4, None), (5, ["userget", "userget"]), (6, ["İstanbuluser"])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, words array<string>, cost int")
    got = {r["id"]: r["words"] for r in sg.split_same_case(df, dictionary).collect()}
    assert got[1] == ["get", "user", "name", "X", "USER", "NAME"] and got[2] == ["Get", "names", "getUser", "getqqq", "get"]
    assert got[3] == [] and got[4] is None and got[5] == ["user", "get"] * 2 and got[6] == ["İstanbuluser"]


def test_words_of_documents_equal_every_way_to_cut(spark):
    rows = entry.queries()["same_case_split"](spark, SF).collect()
    words = spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = words.groupBy(F.lower("word").alias("word")).count().filter("char_length(word) >= 2").orderBy(F.desc("count"), "word").limit(2000).collect()
    counts = {r["word"]: float(r["count"]) for r in counts}
    assert len(rows) == words.select(F.lower("word")).distinct().count()
    short = [r for r in rows if len(r["word"]) <= 12]
    for r in [*short[:: max(1, len(short) // 250)]]:
        pieces, cost = brute_force(r["word"], counts)
        assert r["pieces"].split(" ") == pieces and r["cost"] == pytest.approx(cost, abs=1e-6)
    assert sum(" " in r["pieces"] for r in rows) > len(rows) / 10
