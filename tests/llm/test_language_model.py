import math
import re
import zlib
from collections import Counter

import pytest

from glossa.llm.language_model import op4_language_model

SF = "/root/testdata/sf0.001"
END = None


def tokens(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


def test_counts_and_base_score_equal_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in docs}
    count = Counter(t for d, text in docs.items() if not held[d] for t in tokens(text))
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in op4_language_model(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        own, r = tokens(text), got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(own), sum(count[t] > 0 for t in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own), rel=1e-9)
    out = [r for d, r in got.items() if held[d]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
