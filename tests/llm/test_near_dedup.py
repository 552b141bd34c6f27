"""Near duplicates in families of many documents that share a long passage, against brute force."""

from itertools import combinations

import numpy as np

import corpus_pipeline
from glossa.llm import near_dedup


def shingles(text, k):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def family(pairs, own, seed):
    """Texts that share 160 words; each two of a pair share 16 more and have ``own`` words of their own."""
    rng = np.random.default_rng(seed)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 1 << 40, n)]
    shared, out = words(160), []
    for _ in range(pairs):
        both = words(16)
        out += [" ".join(shared + both + words(own)) for _ in range(2)]
    return dict(enumerate(np.array(out)[rng.permutation(len(out))].tolist()))


def groups(texts, k, percent):
    """Each id's smallest reachable id, from all pairs."""
    sets, root = {d: shingles(t, k) for d, t in texts.items()}, {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in texts}


def test_links_at_the_threshold_in_a_large_family(spark):
    texts = family(300, 12, 1)
    want = groups(texts, 3, 85)
    assert len(set(want.values())) == 300
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs).collect()} == want


def test_nodes_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL", 50)
    texts = family(150, 12, 2)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs).collect()} == groups(texts, 3, 85)


def test_stage_keeps_one_of_each_pair_in_a_large_family(spark):
    texts = family(300, 16, 3)
    want = groups(texts, 5, 80)
    assert len(set(want.values())) == 300
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()} == set(want.values())


def boilerplate(pairs):
    """Texts of 200 words, 178 of them shared by all; each two share 8 more: 0.868 alike, and 0.8 to all others."""
    shared = " ".join(f"t{i}" for i in range(178))
    both = [" ".join(f"b{p}_{i}" for i in range(8)) for p in range(pairs)]
    return [(2 * p + q, f"{shared} {both[p]} " + " ".join(f"o{p}_{q}_{i}" for i in range(14))) for p in range(pairs) for q in (0, 1)]


def test_recall_in_boilerplate(spark):
    docs = spark.createDataFrame(boilerplate(1500), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs).collect()}
    assert all(got[d] in (d, d - d % 2) for d in got)  # no false links
    assert sum(got[2 * p + 1] == 2 * p for p in range(1500)) >= 0.95 * 1500


def test_recall_where_nodes_are_divided(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL", 64)
    monkeypatch.setattr(near_dedup, "WHOLE", 64)
    docs = spark.createDataFrame(boilerplate(300), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs).collect()}
    assert all(got[d] in (d, d - d % 2) for d in got)
    assert sum(got[2 * p + 1] == 2 * p for p in range(300)) >= 0.95 * 300


def test_spanning_links_equal_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(20):
        base = rng.integers(0, 1 << 60, 120).astype(np.uint64)
        sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(80, 120), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 15)).astype(np.uint64)))) for _ in range(60)]
        own, block = rng.integers(0, 50, 60), rng.integers(0, 2, 60)
        for use in (None, block):
            root = {("own", g): ("own", g) for g in own.tolist()}

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            want, got = dict(root), dict(root)
            for edges, to in (([(i, j) for i, j in combinations(range(60), 2) if use is None or use[i] != use[j]], want), (near_dedup.spanning(sets, own, use, 85), got)):
                for i, j in edges:
                    both = len(np.intersect1d(sets[i], sets[j]))
                    alike = 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both)
                    assert alike or to is want
                    if alike:
                        x, y = (find(("own", int(own[e])), to) for e in (i, j))
                        to[max(x, y)] = min(x, y)
            assert {x: find(x, want) for x in root} == {x: find(x, got) for x in root}


def test_repeats_null_ids_large_groups_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(i, text if i % 2 else text.upper(), 0, 0) for i in range(400)]
    rows += [(1, text, 0, 0), (None, text, 0, 0), (None, "a b c d", 0, 0), (900, "", 0, 0), (901, None, 0, 0), (902, "a b c d", 0, 0), (903, " \t", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, own int")
    got = [tuple(r) for r in near_dedup.near_groups(docs).collect()]
    assert sorted((r for r in got if r[0] is not None and r[0] < 900), key=str) == sorted([(i, 48, 0, i == 0) for i in [*range(400), 1]], key=str)
    assert sorted(r for r in got if r[0] is not None and r[0] >= 900) == [(900, 0, 900, True), (901, 0, 901, True), (902, 2, 902, True), (903, 0, 903, True)]
    assert sorted(r[1:] for r in got if r[0] is None) == [(2, 902, False), (48, 0, False)]
    assert near_dedup.near_groups(docs.limit(0)).collect() == []
