import hashlib
import random
from collections import Counter

import numpy as np

from glossa.llm.substring_dedup import op6_substring_dedup, remove_repeats


def brute(texts, threshold):
    count = Counter(t[i : i + threshold] for t in texts for i in range(len(t) - threshold + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - threshold + 1):
            if count[t[i : i + threshold]] > 1:
                gone[i : i + threshold] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept))
    return out


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    want = brute([(d["text"] or "").encode() for d in docs], 400)
    got = sorted(op6_substring_dedup(spark, sf).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == [(*w[:3], hashlib.sha256(w[3]).hexdigest()) for w in want]
    assert any(w[1] for w in want)


def test_small_thresholds_and_periodic_texts(spark):
    rng = random.Random(5)
    some = ["".join(rng.choices("abc ", k=rng.randint(1, 90))) for _ in range(12)]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 12))) for _ in range(60)] + ["ab" * 300, "é" * 200, "", None, "x" * 99, "x" * 100, "x" * 101, "q" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS kept", "3 AS block")
    got = sorted(remove_repeats(docs, threshold=100, block_bytes=4000).collect(), key=lambda r: r["doc_id"])
    want = brute([(t or "").encode() for t in texts], 100)
    assert [(r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got] == want


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(1, "a" + "z" * 10 + "b" * 400)] * 2 + [(None, "c" * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"]) for r in remove_repeats(docs).collect())
    assert got == [(20, 0), (411, 411), (411, 411)]
    assert remove_repeats(docs.limit(0)).count() == 0


def test_samples_are_read_as_arrays():
    import tracemalloc

    import pyarrow as pa

    from glossa.llm import substring_dedup as s

    rng = np.random.default_rng(3)
    docs = []
    for k in (1, 40, 100_000, 7):
        a = np.arange(k) * 3
        docs.append({"kind": rng.integers(0, 2, k), "name": rng.integers(0, 1 << 60, k), "n": rng.integers(2, 9, k), "a": a, "b": a + rng.integers(0, 12, k)})
    rows = [pa.StructArray.from_arrays([pa.array(c, pa.int32() if x in ("kind", "a", "b") else pa.int64()) for x, c in d.items()], list(d)) for d in docs]
    lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.concat_arrays(rows))
    tracemalloc.start()
    out = list(s._needed([pa.RecordBatch.from_arrays([lists], ["found"])]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # samples as Python objects took more
    want = []
    for d in docs:
        settled = set()
        for kind, a, b in zip(d["kind"], d["a"], d["b"], strict=True):
            settled.update(range(a, b + 1) if kind == s.DUP else ())
        want += [(x, n) for kind, x, n, a, b in zip(*d.values(), strict=True) if kind == s.SPAN and not settled.issuperset(range(a, b + 1))]
    assert 0 < len(want) < sum(map(len, rows))
    assert [x for b in out for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)] == want


def test_one_name_with_two_checks_is_two_strings():
    from glossa.llm import substring_dedup as s

    names, checks = np.array([7, 3, 7, 7, 3], np.uint64), np.array([2, 1, 1, 2, 1], np.uint64)
    x, y, of = s._distinct(names, checks)
    assert (x.tolist(), y.tolist(), of.tolist()) == ([3, 7, 7], [1, 1, 2], [2, 0, 1, 2, 0])
