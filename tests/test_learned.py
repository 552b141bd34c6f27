"""Registered queries of learned models: whole tables, and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glossa.operators import core
from glossa.plans import catalogue

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("name", "table", "gold", "found", "least"),
    [("crf_roles", "conversations", "role", "predicted", 0.95), ("perceptron_roles", "conversations", "role", "predicted", 0.9), ("crf_tagger", "part", "gold", "tags", 0.95), ("boosted_languages", "documents", "lang", "predicted", 0.9),
     ("forest_languages", "documents", "lang", "predicted", 0.8), ("reweighted_languages", "documents", "lang", "predicted", 0.8)],
)
def test_held_out_rows(spark, name, table, gold, found, least):
    rows = entry.queries()[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    held = [r[gold] == r[found] for r in rows if r["is_test"] and r[gold] is not None]
    assert len(held) > 50 and np.mean(held) > least


def test_equal_identifiers_are_split_and_tagged_once(spark, tmp_path, monkeypatch):
    few, d = spark.read.parquet("/root/testdata/sf0.001/part.parquet"), str(tmp_path)
    odd = few.filter("p_partkey < 2").withColumns({"p_partkey": F.when(F.col("p_partkey") == 0, F.lit(100_000).cast("long")), "p_name": F.lit(None).cast("string")})
    copies = few.crossJoin(spark.range(30).withColumnRenamed("id", "k")).withColumn("p_partkey", F.col("p_partkey") + 200 * F.col("k")).drop("k")
    copies.unionByName(odd).write.parquet(f"{d}/part.parquet")
    rows = catalogue.tagged(spark, d).withColumn("last", F.try_element_at("tags", F.lit(-1)))
    want = {(r["id"], r["is_test"], " ".join(filter(None, r["tags"]))) for r in core.stratified_split(rows, "last", "id", 0.15, 209).collect()}
    seen, tag_words = spark.sparkContext.accumulator(0), core.tag_words

    @F.udf("array<string>")
    def counted(x):
        seen.add(1)
        return x

    monkeypatch.setattr(core, "tag_words", lambda words: counted(tag_words(words)))
    got = entry.queries()["crf_tagger"](spark, d).collect()
    assert len(got) == len(want) == 6_002 and {(r["id"], r["is_test"], r["gold"]) for r in got} == want
    assert seen.value == rows.select("name", "context").distinct().count() <= 202
    assert all(len(r["tags"].split()) == len(r["gold"].split()) for r in got)
