"""Queries of corpus operators against their SQL, and held-out accuracy where there is none."""

import zlib

import duckdb
import numpy as np
import pytest

from glossa.llm import queries

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
TABLES = ("documents", "embeddings", "pages", "benchmark")


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def near(rows):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    own = [c[0] for c in want.description]
    names = sorted(own)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == names
    assert near(got.select(names).collect()) == near([r[own.index(c)] for c in names] for r in want.fetchall())


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.queries()["op3_quality"](spark, LARGER).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (remainder(d, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in got.items())
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").filter("quality IS NOT NULL").collect()
    right = [got[r["doc_id"]]["predicted"] == r["quality"] for r in labels if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    assert len(right) > 50 and np.mean(right) > 0.95


def test_language_of_held_out_documents(spark):
    rows = spark.read.parquet(f"{LARGER}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.queries()["op7_language_id"](spark, LARGER).collect()}
    assert len(got) == len(rows)
    known = {r["lang"] for r in rows if r["lang"] and remainder(r["doc_id"], 4) != 2}
    assert {r["lang_pred"] for r in got.values()} <= known | {"und"}
    assert all(r["held_out"] == (remainder(d, 4) == 2) and 0 <= r["score"] <= 1 for d, r in got.items())
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows if r["lang"] and got[r["doc_id"]]["held_out"] and any(c.isalpha() for c in r["text"] or "")]
    assert len(right) > 50 and np.mean(right) > 0.97


def test_language_model_beats_the_base_on_held_out_documents(spark):
    rows = queries.queries()["op4_language_model"](spark, LARGER).collect()
    assert all(r["held_out"] == (remainder(r["doc_id"], 10) == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] for r in held) / tokens > sum(r["base_score"] for r in held) / tokens + 0.5
    assert all(r["score"] < 0 for r in rows)
