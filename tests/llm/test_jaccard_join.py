import itertools

import numpy as np
import pytest

from glossa.llm import jaccard_join as jj

SCHEMA = "doc_id long, text string, name int, id int, n int, a int, own int, size int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0, 0, 0, 0) for r in rows], SCHEMA)


def plainly(rows, k, percent):
    """Each id's set size and the smallest id that it reaches."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def found(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


def family(rng, first, members, words, edits):
    base = [f"f{first}w{rng.integers(9999)}" for _ in range(words)]
    out = []
    for i in range(members):
        w = list(base)
        for at in rng.integers(0, words, int(rng.integers(0, edits + 1))):
            w[at] = f"e{rng.integers(10**9)}"
        out.append((first + i, " ".join(w)))
    return out


@pytest.fixture
def corpus():
    rng = np.random.default_rng(5)
    common = "this line is the same in every third text of them all".split()
    rows = [(i, " ".join([*(common if i % 3 == 0 else []), *(f"v{rng.integers(300)}" for _ in range(int(rng.integers(0, 60))))])) for i in range(300)]
    rows += family(rng, 1000, 250, 60, 4) + family(rng, 2000, 60, 12, 2) + family(rng, 3000, 12, 900, 30) + family(rng, 4000, 120, 150, 7)
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "One"), (9005, "one two"), (9006, "one two"), (9007, "x " * 60_000), (9008, "x x x")]
    return rows


@pytest.mark.parametrize(("k", "percent", "cell"), [(3, 90, 2048), (3, 90, 16), (5, 80, 64)])
def test_equals_all_pairs(spark, corpus, monkeypatch, k, percent, cell):
    monkeypatch.setattr(jj, "CELL", cell)  # lists in one cell or in many
    assert found(jj.jaccard_groups(docs(spark, corpus), k, percent)) == plainly(corpus, k, percent)


def test_repeats_null_ids_and_empty_tables(spark):
    rows = [(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (None, "q r s"), (9, "A  B c d"), (None, None)]
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jj.jaccard_groups(docs(spark, rows)).collect())
    assert got[:3] == [("4", 2, 4), ("4", 2, 4), ("9", 2, 4)] and ("None", 2, 4) in got and len(got) == 6
    assert jj.jaccard_groups(docs(spark, []).limit(0)).count() == 0


def test_prefixes_of_similar_sets_share_what_is_required():
    """For random sets and orders: pairs at the threshold share l shingles within prefixes for l, for every l."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(2, 80))
        names = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        a = np.unique(names)
        b = np.unique(np.concatenate((rng.permutation(a)[int(rng.integers(0, 6)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 4)), dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both < 90 * (len(a) + len(b) - both):
            continue
        large, small = sorted((a, b), key=len, reverse=True)
        df = {x: int(rng.integers(2, 9)) for x in np.union1d(a, b).tolist()}
        at = {id(s): jj.place(np.diff([0, *np.searchsorted(s, jj.RANGES), len(s)]), s, np.array([df[x] for x in s.tolist()])) for s in (large, small)}
        for matches in range(1, min(jj.MATCHES, jj.probe_overlap(len(large), 90)) + 1):
            left = set(large[at[id(large)] < len(large) - jj.probe_overlap(len(large), 90) + matches].tolist())
            right = set(small[at[id(small)] < len(small) - jj.index_overlap(len(small), 90) + matches].tolist())
            assert len(left & right) >= matches


def test_longer_prefixes_are_chosen_where_lists_are_long():
    places = np.arange(20)
    assert jj.choose(100, places, np.full(20, 2), 90) >= 1
    assert jj.choose(100, places, np.full(20, 5000), 90) == jj.MATCHES
    # one more shingle that costs more than all candidates it saves
    assert jj.choose(100, places, np.array([2] * 11 + [10**6] * 9), 90) == 1
