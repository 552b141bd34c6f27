"""Tables of compacted runs: merges, retries, several writers, readers of older manifests; the stream that answers from the cache."""

import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossa.operators.cache import TagCache
from glossa.sources.runs import RunLog
from glossa.streaming import encounters

SCHEMA = "k string, c string, n bigint, top bigint"


def log(spark, path, **more):
    return RunLog(spark, str(path), ["k", "c"], [F.sum("n").alias("n"), F.max("top").alias("top")], SCHEMA, **more)


def batch(spark, i, keys=7):
    return spark.createDataFrame([(f"k{j % keys}" if j % 5 else None, f"c{j % 3}", j, i * j) for j in range(i, i + 20)], SCHEMA)


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.select("k", "c", "n", "top").collect())))


def want(spark, numbers):
    both = [r for i in numbers for r in batch(spark, i).collect()]
    n, top = Counter(), {}
    for k, c, x, t in both:
        n[k, c] += x
        top[k, c] = max(t, top.get((k, c), t))
    return sorted(str((k, c, n[k, c], top[k, c])) for k, c in n)


def test_levels_and_old_readers(spark, tmp_path):
    t = log(spark, tmp_path / "t", buckets=4, fan=3)
    assert t.state().count() == 0 and t.find("k1", "c1").count() == 0
    old = None
    for i in range(10):
        assert t.append(batch(spark, i))
        m = t.manifest()
        assert max(Counter(m.runs.values()).values()) < 3
        if i == 4:
            old = m
    assert sorted(t.manifest().runs.values()) == [0, 2]  # 10 = 9 + 1
    assert rows(t.state()) == want(spark, range(10))
    assert rows(t.state(old)) == want(spark, range(5))
    for k, c in (("k1", "c1"), (None, "c2"), ("zz", "c1")):
        one = t.find(k, c)
        assert rows(one) == [r for r in want(spark, range(10)) if r.startswith(str((k, c))[:-1] + ",")]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    files = {f.split("bucket=")[1].split("/")[0] for f in t._read(t.manifest()).filter(F.col("bucket") == t._bucket(4, F.lit("k1"), F.lit("c1"))).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(files) == 1
    assert t.vacuum(keep=1, older_than=3600) == 0
    assert t.vacuum(keep=1, older_than=-5) > 0
    assert rows(t.state()) == want(spark, range(10)) and len(t._names("runs")) == 2


def test_retries_and_lost_writers(spark, tmp_path):
    t = log(spark, tmp_path / "t", buckets=2)
    assert t.append(batch(spark, 1), "a", 0) and not t.append(batch(spark, 1), "a", 0)
    assert t.append(batch(spark, 2), "a", 1) and t.append(batch(spark, 3), "b", 0) and not t.append(batch(spark, 1), "a", 0)
    t._write(batch(spark, 9), t.manifest())  # a run without a manifest
    assert rows(t.state()) == want(spark, [1, 2, 3])
    assert rows(log(spark, tmp_path / "t", buckets=8).state()) == want(spark, [1, 2, 3])
    assert log(spark, tmp_path / "t", buckets=8).append(batch(spark, 4))
    assert rows(t.state()) == want(spark, [1, 2, 3, 4]) and t.manifest().buckets == 2
    assert t.append(batch(spark, 5).limit(0), "c", 0)
    assert rows(t.state()) == want(spark, [1, 2, 3, 4])
    with pytest.raises(ValueError, match="keyed by"):
        RunLog(spark, str(tmp_path / "t"), ["k"], []).manifest()
    with pytest.raises(ValueError, match="nothing at"):
        RunLog(spark, str(tmp_path / "none"), ["k"], []).state()


def test_writers_at_once(spark, tmp_path):
    failed = []

    def run(name):
        try:
            for i in range(4):
                log(spark, tmp_path / "t", buckets=2, fan=2).append(batch(spark, i), name, i)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=run, args=(f"w{x}",)) for x in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed
    assert rows(log(spark, tmp_path / "t").state()) == want(spark, list(range(4)) * 3)


def test_cache_batches_count_once(spark, tmp_path):
    store = TagCache(spark, str(tmp_path), buckets=2, fan=2)
    asked = spark.createDataFrame([("a", "x", None, "2020-01-01 00:00:00"), ("a", "x", None, "2020-01-03 00:00:00")], "cache_id string, name string, context string, t string")
    assert store.encounter(asked, "t", "w", 0) and not store.encounter(asked, "t", "w", 0) and store.encounter(asked.limit(1), "t", "w", 1)
    assert [(r["cnt"], r["last_encounter"].day) for r in store.encounters().collect()] == [(3, 3)]


def test_answers_from_the_cache(spark, tmp_path):
    schema = "id int, cache_id string, name string, context string, t timestamp"
    tag = F.concat(F.lit("tags of "), F.coalesce("name", F.lit("nothing")))
    source, out, store = str(tmp_path / "in"), str(tmp_path / "out"), TagCache(spark, str(tmp_path / "cache"))
    store.add(spark.createDataFrame([("a", "known", "CLASS", "by hand")], "cache_id string, name string, context string, words string"))

    def send(ids):
        keys = {0: ("a", "known", "CLASS"), 1: ("a", "new", "CLASS"), 2: ("b", "new", "CLASS"), 3: ("a", None, None)}
        one = spark.createDataFrame([(i, *keys[i % 4]) for i in ids], "id int, cache_id string, name string, context string").withColumn("t", F.lit("2020-01-01").cast("timestamp"))
        one.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        encounters.answer_stream(stream, store.path, "t", tag, out, str(tmp_path / "log")).awaitTermination()

    send(range(8))
    send(range(8, 12))
    got = {r["id"]: r for r in encounters.answers(spark, out).collect()}
    assert len(got) == encounters.answers(spark, out).count() == 12
    words = ["by hand", "tags of new", "tags of new", "tags of nothing"]
    assert all(got[i]["words"] == words[i % 4] for i in got)
    assert [got[i]["hit"] for i in range(12)] == [True, False, False, False] * 2 + [True] * 4
    assert [got[i]["cnt"] for i in range(12)] == [None] * 8 + [2] * 4  # what had been seen before
    assert {(r["cache_id"], r["name"]): r["cnt"] for r in store.encounters().collect()} == {("a", "known"): 3, ("a", "new"): 3, ("b", "new"): 3, ("a", None): 3}
    # a batch that is run again changes nothing and answers as before
    again = spark.createDataFrame([(0, "a", "known", "CLASS"), (1, "a", "new", "CLASS"), (3, "a", None, None)], "id int, cache_id string, name string, context string").withColumn("t", F.lit("2020-01-01").cast("timestamp"))
    for _ in range(2):
        r = {x["id"]: x for x in encounters.answer_batch(store, again, "t", tag, "w", 5).collect()}
        assert all(r[i]["hit"] and r[i]["cnt"] == 3 for i in (0, 1, 3))
    assert sorted({r["cnt"] for r in store.encounters().collect()}) == [3, 4]
