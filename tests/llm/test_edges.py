import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import exact_dedup, language_id, language_model, mixing, near_dedup, quality, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, row int, id int, n int, key int, size int"


def docs(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n", "en", "a"), (4, "a b c d", "en", None), (5, "a  b c d", "de", "b"), (6, "1 2 !", None, "b"), (7, "x" + " word" * 50_000, "de", "c")]
    return spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in rows], SCHEMA)


def test_exact_dedup(spark):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(docs(spark)).collect()}
    assert got[1] == got[2] == (3, 3, False) and got[3] == (3, 3, True)
    assert got[4] == (5, 2, False) and got[5][2] and got[7] == (7, 1, True)
    assert exact_dedup.dedup(docs(spark).limit(0)).count() == 0


def test_digest_index_is_kept_between_batches(spark):
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.dedup(docs(spark).filter("doc_id <= 4"), index)
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.dedup(docs(spark).filter("doc_id > 4"), index).collect()}
    assert got == {5: 4, 6: 6, 7: 7}


def test_digest_index_is_opened_by_path(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    exact_dedup.dedup(docs(spark).filter("doc_id <= 4"), exact_dedup.DigestIndex(spark, path=path, table="index_made"))
    spark.sql("DROP TABLE index_made")  # its name only: the files outlive the session that made them
    again = exact_dedup.DigestIndex(spark, path=path, table="index_opened")
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.dedup(docs(spark).filter("doc_id > 3"), again).collect()}
    assert got == {4: 4, 5: 4, 6: 6, 7: 7} and again.frame().count() == 4


@pytest.mark.parametrize("partitions", [4, 8, 16])
def test_digest_index_keeps_its_number_of_buckets(spark, tmp_path, partitions):
    """An index of 8 buckets knows every text that it was given, whatever the session's number of partitions."""
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    path, own = f"file://{tmp_path}/index", spark.conf.get("spark.sql.shuffle.partitions")
    exact_dedup.dedup(rows, exact_dedup.DigestIndex(spark, path=path, table=f"made_{partitions}", buckets=8))
    spark.sql(f"DROP TABLE made_{partitions}")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        again = exact_dedup.DigestIndex(spark, path=path, table=f"opened_{partitions}")
        got = exact_dedup.dedup(rows.withColumn("doc_id", F.col("doc_id") + 1000), again)
        assert got.filter("kept").count() == 0 and again.frame().count() == 200 and again.buckets == 8
        assert exact_dedup.DigestIndex(spark, table=f"opened_{partitions}").buckets == 8
        for odd in ({"path": path, "buckets": 4}, {"path": path, "id_type": "string"}, {"table": f"opened_{partitions}", "buckets": 16}, {"path": f"file://{tmp_path}"}):
            with pytest.raises(ValueError, match="index"):
                exact_dedup.DigestIndex(spark, **odd)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)


def test_exact_dedup_of_equal_lengths_repeats_and_null_ids(spark):
    rows = [(5, "ab c"), (4, "a bc"), (4, "a bc"), (None, "abc "), (None, "z"), (9, " z")]
    got = sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("4", 4, 4, True), ("4", 4, 4, True), ("5", 4, 4, False), ("9", 9, 2, True), ("None", 4, 4, False), ("None", 9, 2, False)]


def test_near_dedup(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(docs(spark)).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (2, 4), 5: (2, 4), 6: (1, 6), 7: (2, 7)}
    assert near_dedup.near_groups(docs(spark).limit(0)).count() == 0


def test_language_model(spark):
    s = language_model.score(docs(spark), F.col("doc_id") > 0, F.col("doc_id") == 5)
    got = {r["doc_id"]: r for r in s.frame.collect()}
    assert len(got) == 7 and got[1]["n_tokens"] == 1 and got[7]["n_tokens"] == 50_002
    assert all(np.isfinite(r["score"]) for r in got.values())
    assert language_model.score(docs(spark).limit(0), F.col("doc_id") > 0, F.col("doc_id") == 5).frame.count() == 0


def test_language_id_and_quality(spark):
    d = docs(spark)
    m = language_id.train(d, d["doc_id"] < 0)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(d, m).collect()}
    assert [got[i] for i in (1, 2, 3, 6)] == ["und"] * 4 and got[7] == "de"
    assert language_id.predict(d, None).filter("lang_pred <> 'und'").count() == 0
    labels = spark.createDataFrame([(4, 1), (7, 0), (5, None)], "doc_id long, quality int")
    q = quality.train(d, labels, labels["doc_id"] < 0)
    got = quality.score(d, q).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(d, None).select("score").distinct().collect()[0][0] == 0.5


def test_mixing(spark):
    got = {r["doc_id"]: r for r in mixing.mix(docs(spark)).collect()}
    assert len(got) == 7 and got[1]["taken"] == 0 and all(r["taken"] <= 3 * r["size"] for r in got.values())
    assert mixing.mix(docs(spark).limit(0)).count() == 0
    got = mixing.targets([("a", 100), (None, 10)])
    assert got == {"a": 110 * 5 / 7, None: 30.0} or abs(got["a"] - 80) < 1e-9 and got[None] == 30
    assert abs(sum(got.values()) - 110) < 1e-9


def test_mixing_takes_the_same_whatever_the_partitions_and_names_its_rows(spark):
    rows = [(i % 40, "word " * (1 + i % 7), "ab"[i % 3 == 0], i) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, at long")
    runs = [sorted(tuple(r) for r in mixing.mix(d.repartition(n), key_col="at").collect()) for n in (1, 7)]
    assert [(r[0], r[1]) for r in runs[0]] == [(i, i % 40) for i in range(300)]
    # rows that repeat an id come in any order among themselves, so only ids are compared
    by_id = [sorted((r[1], r[2], r[5]) for r in run) for run in runs]
    assert sum(x[2] for x in by_id[0]) == sum(x[2] for x in by_id[1])
    own = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], d.schema)
    runs = [sorted(tuple(r) for r in mixing.mix(own.repartition(n)).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]
    total = sum(r[1] for r in runs[0])
    assert total - 7 < sum(r[4] for r in runs[0]) <= total


def test_mixing_over_many_ranges(spark, monkeypatch):
    d = spark.createDataFrame([(i, "word " * (1 + i % 5), "abc"[i % 3]) for i in range(400)], "doc_id long, text string, source string")
    want = sorted(tuple(r) for r in mixing.mix(d).collect())
    monkeypatch.setattr(mixing, "ROWS_A_RANGE", 20)
    monkeypatch.setattr(mixing, "ROWS_A_BIN", 16)
    assert sorted(tuple(r) for r in mixing.mix(d).collect()) == want


def test_url_filter_of_repeats_long_urls_and_clashing_names(spark):
    rows = [(1, "http://example.com/en/" + "x" * 100_000, "a", "b", "c", 0)] * 2 + [(None, "HTTP://EXAMPLE.COM/en/", "a", "b", "c", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, verdict string, key int")
    got = [(r["page_id"], r["host"], len(r["path"]), r["verdict"]) for r in url_filter.judge(pages).collect()]
    assert sorted(got, key=str) == [(1, "example.com", 100_004, "block")] * 2 + [(None, "example.com", 4, "block")]


def test_language_id_and_quality_of_repeats_and_one_class(spark):
    d = spark.createDataFrame([(1, "ab cd", "xx", 0), (1, "ab cd", "xx", 0), (None, "ab cd", None, 0), (2, None, "xx", 0)], "doc_id long, text string, lang string, score int")
    got = [tuple(r) for r in language_id.predict(d, language_id.train(d, F.lit(False))).collect()]
    assert sorted(got, key=str) == [(1, "xx", 1.0), (1, "xx", 1.0), (2, "und", 0.0), (None, "xx", 1.0)]
    assert language_id.predict(d.limit(0), language_id.train(d, F.lit(False))).count() == 0
    assert language_id.train(d.limit(0), F.lit(False)) is None
    labels = spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, quality int")
    got = quality.score(d, quality.train(d, labels, F.lit(False))).collect()
    assert len(got) == 4 and len({r["score"] for r in got if r["doc_id"] != 2}) == 1
    assert quality.score(d.limit(0), quality.train(d, labels, F.lit(False))).count() == 0


def test_language_model_of_repeats_and_null_ids(spark):
    d = spark.createDataFrame([(1, "a b a", 0), (1, "a b a", 0), (None, "a c", 0)], "doc_id long, text string, names int")
    s = language_model.score(d, F.col("doc_id") > 0, F.lit(False))
    got = sorted([(r["doc_id"], r["n_tokens"], r["n_known"]) for r in s.frame.collect()], key=str)
    assert got == [(1, 4, 4), (1, 4, 4), (None, 3, 2)] and s.train_tokens == 8


def test_url_filter(spark):
    urls = [None, "", "x.com/", "http://A.Example.com/en/x?q", "https://example.com", "http://www.example.com/en/", "http://a.net/es/#f", "http://org.org/en/"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got[0] == got[1] == got[2] == ("", None, "allow")
    assert got[3] == ("a.example.com", "example.com/en/", "block") and got[4] == ("example.com", None, "allow")
    assert got[5] == ("www.example.com", "www.example.com/en/", "allow") and got[6] == ("a.net", "net/es/", "block") and got[7][1] is None
    assert url_filter.judge(pages.limit(0)).count() == 0
