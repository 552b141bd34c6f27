"""Queries over vectors read every component."""

import __spark_entry__ as entry
from glossa.functions.lexicon import TAGS

SF = "/root/testdata/sf0.001"


def test_viterbi_decodes_all_components(spark):
    vec = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    best = lambda x: TAGS[x.index(max(x))]  # noqa: E731  steps are independent, as all transitions weigh the same
    got = {r["vec_id"]: r["tags"].split() for r in entry.queries()["viterbi_decode"](spark, SF).collect()}
    assert got == {i: [best(v[a : a + 10]) for a in range(0, 64, 10)] for i, v in vec.items()}


def test_importance_of_every_component(spark):
    got = entry.queries()["permutation_importance"](spark, SF).collect()
    assert sorted(r["feature"] for r in got) == sorted(f"x{i}" for i in range(64))
