import hashlib

import numpy as np

import corpus_pipeline
from glossa.llm import bpe, language_id, mixing
from glossa.llm.exact_dedup import WHITE

SF = "/root/testdata/sf0.001"


def shingles(text, k):
    w = text.encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def near_kept(docs, k, percent):
    sets = {d: shingles(t, k) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in docs:
        for b in docs:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in docs if find(d) == d}


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = [f for _, f in corpus_pipeline.STAGES]

    known = stage[0](spark, docs, SF)
    assert known.columns == docs.columns
    model = language_id.train(docs, docs["doc_id"] < 0)
    said = language_id.predict(docs, model).collect()
    assert {r["doc_id"] for r in known.collect()} == {r["doc_id"] for r in said if r["lang_pred"] != "und" and r["score"] >= model.least}
    assert known.count() > 0.9 * len(text)

    single = stage[1](spark, known, SF)
    groups = {}
    for r in known.collect():
        groups.setdefault(r["text"].translate({ord(c): None for c in WHITE}), []).append((-len(r["text"]), r["doc_id"]))
    assert {r["doc_id"] for r in single.collect()} == {min(g)[1] for g in groups.values()}

    apart = stage[2](spark, single, SF)
    assert {r["doc_id"] for r in apart.collect()} == near_kept({r["doc_id"]: r["text"] for r in single.collect()}, 5, 80)

    mix = stage[3](spark, apart, SF)
    assert mix.columns == docs.columns
    goal = {r["source"]: r["target"] for r in mixing.mix(apart).join(apart.select("doc_id", "source"), "doc_id").collect()}
    got = {}
    for r in mix.collect():
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].encode().split())
    longest = max(len(t.split()) for t in text.values())
    assert all(abs(got.get(s, 0) - g) <= longest for s, g in goal.items())

    t = bpe._tokenizer(bpe.vocabulary())
    out = stage[4](spark, mix, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in mix.collect())
    for r in out[:50]:
        ids = t.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_nulls_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b", None, None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for some, want in ((docs, [3]), (docs.limit(0), [])):
        for _, f in corpus_pipeline.STAGES:
            some = f(spark, some, SF)
        assert sorted({r["doc_id"] for r in some.collect()}) == want


def test_repeated_rows_null_ids_and_clashing_names(spark):
    word = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    near = word(1, 60).split()
    rows = [
        (1, word(1, 60)), (1, word(1, 60)), (None, word(1, 60)),  # copies, one of the same id
        (2, " ".join(near[:-1])), (None, " ".join(near[1:])),  # near copies
        (3, word(3, 30)), (3, word(4, 30)), (None, word(5, 30)), (None, word(6, 30)),  # different texts without an id of their own
    ]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t), 7, 8, 9) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row int, row int, _times int")
    single = corpus_pipeline.without_copies(spark, docs, "")
    assert single.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in single.collect()) == sorted({(d or 0, t) for d, t in rows} - {(0, word(1, 60))})
    apart = corpus_pipeline.without_near_copies(spark, single, "")
    want = [(0, word(5, 30)), (0, word(6, 30)), (1, word(1, 60)), (3, word(3, 30)), (3, word(4, 30))]
    assert apart.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"]) for r in apart.collect()) == sorted(want)
    mix = corpus_pipeline.mixed(spark, apart, "")
    assert mix.columns == docs.columns  # one source: its target is its size, so each row is taken once
    assert sorted((r["doc_id"] or 0, r["text"]) for r in mix.collect()) == sorted(want)
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.encoded(spark, mix, "").collect()) == [0, 0, 1, 3, 3]
    assert corpus_pipeline.known_language(spark, docs, "").columns == docs.columns
