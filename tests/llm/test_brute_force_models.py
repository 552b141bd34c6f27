"""Scores of the models that SQL can't express, recomputed in plain Python."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import zstandard
from pyspark.sql import functions as F

from glossa.llm import language_id, language_model, quality
from glossa.llm.shared import crc_mod

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split(None) if text else []


def test_language_model_score(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = crc_mod("doc_id", 10)
    s = language_model.score(docs, fold != 0, fold == 1)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    part = {d: zlib.crc32(str(d).encode()) % 10 for d in rows}
    end, one, two = "</s>", {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    texts = {d: [*words(t), end] for d, t in rows.items()}
    for d, t in texts.items():
        if part[d]:
            one[part[d] == 1].update(t)
            two[part[d] == 1].update(zip([end, *t], t, strict=False))
    total, types = sum(one[0].values()) + sum(one[1].values()), len(one[0] + one[1])
    assert (s.train_tokens, s.types) == (total, types)

    # expectation-maximisation over every bigram of the documents kept apart, by bucket of its context
    held, main = defaultdict(list), sum(one[0].values())
    for (a, b), n in two[1].items():
        c = one[0][a]
        step = lambda p: 2 ** (round(math.log2(p) * 8) / 8) if p else 0.0
        held[int(math.log2(c)) + 1 if c else 0].append((n, 1 / (types + 1), step(one[0][b] / main), step(two[0][a, b] / c if c else 0)))
    for k, cells in held.items():
        n, p, w = np.array([c[0] for c in cells]), np.array([c[1:] for c in cells]), np.array([0.1, 0.9, 0.0] if not k else [0.1, 0.45, 0.45])
        for _ in range(60):
            share = p * w
            w = (n[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) + 1e-3
            w = w / w.sum() if k else np.array([w[0], w[1], 0]) / (w[0] + w[1])
        assert np.allclose(w, s.weights[k], atol=1e-6), k

    both, pair = one[0] + one[1], two[0] + two[1]
    for r in s.frame.collect():
        want = 0.0
        for a, b in zip([end, *texts[r["doc_id"]]], texts[r["doc_id"]], strict=False):
            c = both[a]
            w = s.weights[int(math.log2(c)) + 1 if c else 0]
            want += math.log10(w[0] / (types + 1) + w[1] * both[b] / total + (w[2] * pair[a, b] / c if c else 0))
        assert math.isclose(r["score"], want, rel_tol=1e-9), r["doc_id"]


def test_quality_score(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, crc_mod("doc_id", 3) == 1)
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    made = [zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    for r in quality.score(docs, model).collect():
        t = text[r["doc_id"]]
        good, bad = (sum(len(c.compress(t[i : i + 1024])) for i in range(0, len(t), 1024)) for c in made)
        x = ((bad - good) / (bad + good), math.log((bad + good) / 2 / len(t))) if t else (0, 0)
        want = 1 / (1 + math.exp(-(x[0] * model.weights[0] + x[1] * model.weights[1] + model.bias)))
        assert math.isclose(r["score"], want, rel_tol=1e-2, abs_tol=1e-3), r["doc_id"]


def grams(text, n):
    t = b" " + text.encode().lower() + b" " + b"\0" * n
    own = {t[i : i + n] for i in range(len(t) - n)}
    return own if n <= 2 else {(int.from_bytes(g, "big") * 2654435761 % 2**32) >> 16 for g in own}


def test_language_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["lang"], r["text"]) for r in docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).collect())
    texts, langs = [t for _, _, t in rows], [x for _, x, _ in rows]
    names = sorted(set(langs))
    chosen = [i for x in names for i in [j for j, y in enumerate(langs) if y == x][: 256 // len(names)]]
    marks = [[grams(texts[i], n) for n in (1, 2, 3, 4)] for i in chosen]

    def kernel(text):
        own = [grams(text, n) for n in (1, 2, 3, 4)]
        return [sum(len(a & b) / math.sqrt(len(a) * len(b)) for a, b in zip(own, m, strict=True)) / 4 for m in marks]

    k = np.array([kernel(t) for t in texts])
    values, vectors = np.linalg.eigh(k[chosen])
    keep = values > 1e-6 * values.max()
    phi = k @ (vectors[:, keep] / np.sqrt(values[keep]))
    y = np.where(np.array(langs)[:, None] == names, 1.0, -1.0)
    centred = phi - phi.mean(axis=0)
    beta = np.linalg.solve(centred.T @ centred + 0.1 * np.eye(phi.shape[1]), centred.T @ (y - y.mean(axis=0)))
    want = np.clip((centred @ beta + y.mean(axis=0) + 1) / 2, 0, 1)
    model = language_id.train(docs, F.lit(False))
    assert model.langs == names
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    for (d, _, t), w in zip(rows, want, strict=True):
        if any(c.isalpha() for c in t):
            assert abs(got[d]["score"] - w.max()) < 0.02, d
            assert got[d]["lang_pred"] == names[w.argmax()] or np.sort(w)[-1] - np.sort(w)[-2] < 0.02
