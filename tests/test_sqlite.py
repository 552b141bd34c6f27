"""SQLite files: equal rows for any number of partitions, filters in the file, odd tables, and files that tasks write."""

import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from glossa.sources.sqlite import SQLiteSource, _Reader, read_sqlite, write_sqlite


@pytest.fixture(scope="module")
def db(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "a b.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE words (id INTEGER PRIMARY KEY, word TEXT COLLATE NOCASE, share REAL, day DATE, raw BLOB, ok BOOLEAN)")
    rows = [(i * i, None if i % 7 == 0 else f"{'Ab' if i % 2 else 'ab'}'{i}é", i / 3, "2024-01-02", bytes([i % 256]), i % 2) for i in range(-30, 300) if i >= 0]
    con.executemany("INSERT INTO words VALUES (?, ?, ?, ?, ?, ?)", rows)
    con.execute("CREATE TABLE bare (k TEXT PRIMARY KEY, rowid TEXT) WITHOUT ROWID")
    con.execute("INSERT INTO bare VALUES ('a', 'x'), ('b', NULL)")
    con.execute("CREATE TABLE hidden (rowid TEXT, n INT)")
    con.executemany("INSERT INTO hidden VALUES (?, ?)", [("r", i) for i in range(50)])
    con.execute("CREATE VIEW few AS SELECT word, id FROM words WHERE id < 100")
    con.execute("CREATE TABLE none (a INT, b TEXT)")
    con.execute("CREATE TABLE odd (n INT)")
    con.execute("INSERT INTO odd VALUES (1), ('no number')")
    con.commit()
    con.close()
    return path, rows


def test_rows_are_equal_for_any_number_of_partitions(spark, db):
    path, rows = db
    for n in (1, 7):
        df = read_sqlite(spark, path, "words", partitions=n)
        assert df.rdd.getNumPartitions() == n
        assert sorted(tuple(r) for r in df.collect()) == sorted(rows, key=lambda r: r[0])
    assert df.dtypes == [("id", "bigint"), ("word", "string"), ("share", "double"), ("day", "string"), ("raw", "binary"), ("ok", "bigint")]
    assert read_sqlite(spark, path, "words", ["share", "id"]).columns == ["share", "id"]


def test_tables_without_row_numbers_views_and_no_rows(spark, db):
    path, rows = db
    assert sorted(map(tuple, read_sqlite(spark, path, "bare").collect())) == [("a", "x"), ("b", None)]
    hidden = read_sqlite(spark, path, "hidden", partitions=5)
    assert hidden.rdd.getNumPartitions() == 5 and sorted(r["n"] for r in hidden.collect()) == list(range(50))
    assert read_sqlite(spark, path, "few").count() == 10
    assert read_sqlite(spark, path, "none").collect() == []
    with pytest.raises(Exception, match="no table"):
        read_sqlite(spark, path, "nothing").collect()
    with pytest.raises(Exception, match="absent"):
        read_sqlite(spark, path + "absent", "words").collect()
    with pytest.raises(Exception, match="(?i)no number|convert|type"):
        read_sqlite(spark, path, "odd").collect()


FILTERS = [
    "id > 100 AND id <= 5000", "word = 'ab''4é'", "word >= 'a'", "word IN ('ab''2é', 'Ab''5é', 'zz')", "word IS NULL", "word <=> NULL OR id = 4",
    "word LIKE 'Ab%'", "NOT word LIKE 'Ab%'", "share < 2.5D", "NOT (id = 4)", "word != 'ab''2é'", "share = double('NaN')", "raw = X'03'", "length(word) = 5", "word LIKE '%é'",
]


@pytest.mark.parametrize("condition", FILTERS)
def test_filters_give_the_rows_that_spark_gives(spark, db, condition):
    path, rows = db
    whole = spark.createDataFrame(rows, "id long, word string, share double, day string, raw binary, ok long")
    keys = lambda df: sorted(r["id"] for r in df.filter(condition).collect())
    assert keys(read_sqlite(spark, path, "words", partitions=3)) == keys(whole)


def test_filters_are_in_the_file_and_gone_from_the_plan(spark, db):
    path, _ = db
    pushed = read_sqlite(spark, path, "words").filter("id > 100 AND word LIKE 'Ab%'")
    plan = pushed._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert not re.search(r"\bFilter\b", plan), plan
    kept = read_sqlite(spark, path, "words").filter("length(word) = 5")
    assert re.search(r"\bFilter\b", kept._jdf.queryExecution().toString().split("Physical Plan")[1])
    from pyspark.sql import datasource as ds

    reader = _Reader({"path": path, "table": "words", "partitions": "1"}, SQLiteSource({"path": path, "table": "words"}).schema())
    assert list(reader.pushFilters([ds.GreaterThan(("id",), 100), ds.EqualTo(("raw",), b"1")])) == [ds.EqualTo(("raw",), b"1")]
    batches = list(reader.read(reader.partitions()[0]))
    assert sum(b.num_rows for b in batches) == 289  # squares of 11 to 299


def test_files_of_tasks_come_back_whole_and_changes_are_seen(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 != 0, F.concat(F.lit("w'\n"), "id")).alias("select"), (F.col("id") / 4).alias("x"), F.col("id").cast("string").cast("binary").alias("b"))
    write_sqlite(df.repartition(4), path, "t")
    key = lambda d: sorted(tuple(r) for r in d.fillna("-").collect())
    assert key(read_sqlite(spark, path, "t", partitions=11)) == key(df)
    write_sqlite(df.limit(0), path, "t")
    assert read_sqlite(spark, path, "t").count() == 1000
    write_sqlite(df.filter("id < 5"), path, "t", mode="overwrite")
    again = read_sqlite(spark, f"file://{path}", "t")
    assert again.count() == 5
    with pytest.raises(Exception, match="long, double"):
        write_sqlite(df.select(F.array("id").alias("a")), path, "t")
    part = (reader := _Reader({"path": path, "table": "t"}, df.schema)).partitions()[-1]
    with sqlite3.connect(part.file) as con:
        con.execute("INSERT INTO t VALUES (1, 'x', 1, NULL)")
    con.close()
    with pytest.raises(RuntimeError, match="changed"):
        list(reader.read(part))
