import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from glossa.llm import bpe

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocab():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def test_query_equals_the_library(spark, vocab):
    t = bpe._tokenizer(vocab)
    got = {r["doc_id"]: r for r in bpe.op1_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_splits_are_places_where_the_library_splits(vocab):
    t, rng = bpe._tokenizer(vocab), random.Random(3)
    some = [" ", "  ", "\n", "\t", "a", "b1", "é", "日", ".", "'s", "<|endoftext|>", "\x1c", "\x85", "\xa0", " ", "﻿", "\r", "\x01", "0"]
    for _ in range(3000):
        text = "".join(rng.choices(some, k=rng.randint(0, 9)))
        spelt = [bpe.spelt(w) for w in bpe.words(text)]
        assert "".join(spelt) == text
        whole = t.encode(text, add_special_tokens=False).ids
        assert whole == [i for w in spelt for i in t.encode(w, add_special_tokens=False).ids]


def test_nulls_repeats_long_texts_and_clashing_columns(spark, vocab):
    rows = [(1, None, 0), (1, "", 0), (2, "a b", 1), (2, "a b", 1), (None, "x", 2), (3, "word " * 60_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").selectExpr("*", "1 AS block", "2 AS part", "3 AS id")
    out = bpe.encode(docs, vocab).collect()
    assert sorted(len(r["ids"]) for r in out)[:2] == [0, 0] and len(out) == 6
    assert {(r["doc_id"], r["decoded"]) for r in out} == {(a, t or "") for a, t, _ in rows}
    assert bpe.encode(docs.limit(0), vocab).count() == 0


def test_decode_joins_pieces(spark, vocab):
    t = bpe._tokenizer(vocab)
    texts = ["Héllo wörld", "", "a<|endoftext|>b"]
    rows = [(i, t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)] + [(9, None)]
    got = dict(tuple(r) for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), vocab).collect())
    assert got == dict(enumerate(texts)) | {9: ""}
