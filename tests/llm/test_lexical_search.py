import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glossa.llm import lexical_search as ls

SCHEMA = "doc_id long, text string, item_id int, score int, row int, n int, term string, query int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0, 0, "", 0) for r in rows], SCHEMA)


def items(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "item_id long, text string, doc_id int")


def words(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plainly(rows, queries, k):
    bags = [(i, Counter(words(t)), len(words(t))) for i, t in rows]
    big_n, big_l = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for q, text in queries:
        scored = []
        for i, bag, n in bags:
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * (75 + 25 * n * big_n // big_l))) for t in words(text) if t in bag)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(q, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=str)


@pytest.fixture
def corpus():
    rng = np.random.default_rng(3)
    common, rare = [f"w{i}" for i in range(12)], [f"Ünï{i}" for i in range(150)]
    rows = []
    for i in range(900):
        n = int(rng.integers(1, 40))
        rows.append((i, " ".join(str(rng.choice(rare if rng.random() < 0.15 else common)).upper() if rng.random() < 0.2 else str(rng.choice(common)) for _ in range(n))))
    rows += [(2000 + i, "w1 w2-W3 ÜNÏ7 Ünï7") for i in range(300)]  # a third alike: ranked by id
    rows += [(3000, None), (3001, ""), (3002, " !?"), (None, "w1 w1 w5"), (3003, "w2 " * 30_000), (5, "w1 Ünï3 w1")]
    return rows


@pytest.mark.parametrize(("shard", "pilot", "step", "k"), [(4096, 3, 0.6, 20), (64, 1, 0.9, 3), (300, 9, 0.1, 5)])
def test_equals_exhaustive_scores_however_it_is_dealt(spark, corpus, monkeypatch, shard, pilot, step, k):
    for name, value in (("SHARD", shard), ("PILOT", pilot), ("STEP", step)):
        monkeypatch.setattr(ls, name, value)
    queries = [(1, "w1 w2 Ünï3 Ünï3"), (2, "Ünï7 w3"), (3, ""), (4, None), (5, "nowhere"), (6, " ".join(f"w{i} Ünï{i}" for i in range(12))), (7, "W1"), (None, "w4 ünï4 ÜNï4")]
    got = found(ls.search(docs(spark, corpus), items(spark, queries), k))
    assert got == plainly(corpus, queries, k)


def test_queries_in_several_passes(spark, corpus, monkeypatch):
    monkeypatch.setattr(ls, "TERMS", 5)
    queries = [(1, "w1 w2 Ünï3 Ünï3"), (6, " ".join(f"w{i} Ünï{i}" for i in range(12)))]
    assert found(ls.search(docs(spark, corpus[:200]), items(spark, queries))) == plainly(corpus[:200], queries, 20)


def test_stops_when_bounds_prove_the_first_k():
    """A very common term's postings count in full for what can still be among the first, and no floor lets a better one go."""
    rare, common = [([1], 100 + i) for i in range(6)], [([2], 5)]
    groups = pa.table({"term": [t[0] for t, _ in rare + common], "impact": [x for _, x in rare + common], "rows": [[i] for i in range(6)] + [list(range(1000))]})
    shard = ls.Shard(groups, pa.table({"row": range(1000), "id": range(1000)}))
    best, scores = shard.search([(1, 1), (2, 1)], 3, 0, None)
    assert best.tolist() == [5, 4, 3] and scores.tolist() == [110, 109, 108]
    best, scores = shard.search([(1, 1), (2, 1)], 3, 107, None)
    assert scores.tolist() == [110, 109, 108]
    assert len(shard.search([(1, 1), (2, 1)], 3, 111, None)[0]) == 0


def test_empty_tables(spark, corpus):
    one = items(spark, [(1, "w1")])
    assert ls.search(docs(spark, []), one).count() == 0
    assert ls.search(docs(spark, corpus[:9]), one.limit(0)).count() == 0
