"""Tagger, model selection, cache, streams, readers and small operators."""

import datetime
import difflib
import itertools
import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glossa.functions import lexicon as lx
from glossa.functions import words as w
from glossa.operators import cache, core, models
from glossa.sources import readers
from glossa.streaming import encounters

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["identifier_tagger", "sequence_tagger"])
def test_trained_tagger_on_held_out_identifiers(spark, name):
    rows = entry.queries()[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/part.parquet").count()
    held = [(g, t) for r in rows if r["is_test"] for g, t in zip(r["gold"].split(), r["tags"].split(), strict=True)]
    assert len(held) > 20 and np.mean([g == t for g, t in held]) > 0.9
    if name == "identifier_tagger":
        r = rows[0]
        assert [next(iter(x.values()))["tag"] for x in json.loads(r["response"])["words"]] == r["tags"].split()


def points(spark, n=300):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b), float(c), int(a > 0) + int(b > 0)) for i, (a, b, c) in enumerate(rng.normal(size=(n, 3)))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int")


def test_permutation_importance_deals_out_whole_columns(spark):
    rows = points(spark)
    model = models.fit_tagger(rows, "dt", ["a", "b", "c"])
    got = {r["feature"]: r for r in models.permutation_importance(model, rows, ["a", "b", "c"], "label", "id").collect()}
    # a full shuffle in numpy of the same model
    pdf, rng = rows.toPandas(), np.random.default_rng(0)
    for c in "abc":
        other = pdf.assign(**{c: rng.permutation(pdf[c])})
        p = model.transform(spark.createDataFrame(other)).toPandas()
        assert abs(got[c]["accuracy"] - (1 - (p.prediction == p.label).mean())) < 0.1, c
    assert got["a"]["accuracy"] > 0.2 and abs(got["c"]["accuracy"]) < 0.1


def test_importance_plan_does_not_grow_with_columns(spark):
    rows = points(spark)
    model = models.fit_tagger(rows, "dt", ["a", "b", "c"])
    plans = [models.permutation_importance(model, rows, c, "label", "id")._jdf.queryExecution().optimizedPlan().toString() for c in (["a"], ["a", "b", "c"])]
    assert plans[0].count("Join") == plans[1].count("Join") and plans[0].count("Aggregate") == plans[1].count("Aggregate")


def test_grid_search_and_saved_models(spark, tmp_path):
    rows = points(spark)
    model, table = models.grid_search(rows, "id", {"maxDepth": [1, 4]}, "dt", k=3, columns=["a", "b", "c"])
    got = {json.loads(r["params"])["maxDepth"]: r for r in table.collect()}
    assert got[4]["rank"] == 1 and got[4]["mean_weighted_f1"] > got[1]["mean_weighted_f1"] and got[4]["std_accuracy"] >= 0
    vector = models.fit_tagger(rows.withColumn("vec", F.array("a", "b", "c")), "lr")
    for m, r in ((model, rows), (vector, rows.withColumn("vec", F.array("a", "b", "c")))):
        models.save_tagger(m, f"{tmp_path}/m")
        again = models.load_tagger(spark, f"{tmp_path}/m")
        assert [x["prediction"] for x in m.transform(r).orderBy("id").collect()] == [x["prediction"] for x in again.transform(r).orderBy("id").collect()]
    assert models.best_of(rows, "id", ["dt"], k=2, columns=["a", "b", "c"]) == "dt"


def test_groups_are_on_one_side_of_a_fold(spark):
    rows = core.upsample(points(spark).withColumn("tags", F.array(F.when(F.col("label") == 0, "CJ").otherwise("N"))), core.has_rare_tag(F.col("tags")))
    got = core.folds(rows, "copy", 4, 1, group="id").groupBy("id").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0]
    assert got == 1


def test_ranks_are_whole_over_many_bins(spark):
    rows = points(spark)
    got = core.ranked(rows, "id", 3, "label", bin_rows=10).toPandas()
    for _, g in got.groupby("label"):
        assert sorted(g["_rank"]) == list(range(1, len(g) + 1)) and set(g["_total"]) == {len(g)}


def test_viterbi_and_loss_equal_all_paths(spark):
    rng = np.random.default_rng(1)
    trans = rng.normal(size=(3, 3))
    seqs = [rng.normal(size=(n, 3)) for n in (1, 4, 4, 2)]
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(seqs)] + [(9, [])], "id long, e array<array<double>>")
    got = {r[0]: r[1] for r in df.select("id", models.viterbi(3, trans)(F.col("e"))).collect()}
    assert got[9] == []
    for i, e in enumerate(seqs):
        score = {p: sum(e[t, x] for t, x in enumerate(p)) + sum(trans[a, b] for a, b in itertools.pairwise(p)) for p in itertools.product(range(3), repeat=len(e))}
        assert tuple(got[i]) == max(score, key=score.get)
        p = tuple(rng.integers(0, 3, len(e)))
        assert models.sequence_loss(e, np.array(p), trans) == pytest.approx(np.log(sum(np.exp(s) for s in score.values())) - score[p])
    assert models.sequence_loss(seqs[1], np.array([-100] * 4), trans) == 0


def test_tagger_slot_loads_once_and_sees_batches(spark):
    def load():
        return lambda batch: [["N"] * len(words) for words in batch]

    df = spark.createDataFrame([(["a", "b"],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(models.tagger_slot(load)(F.col("w"))).collect()] == [["N", "N"], []]


def test_similarity_buckets_equal_difflib(spark):
    names = ["getName", "getname", "get", "xyz", "", " ", None, "setName"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for r in df.withColumn("s", w.similarity_bucket("a", "b")).collect():
        x, y = (r["a"] or "").lower(), (r["b"] or "").lower()
        ratio = difflib.SequenceMatcher(None, x, y).ratio() if x.strip() and y.strip() else 0
        assert r["s"] == ("@sim_high" if ratio > 0.9 else "@sim_mid" if ratio > 0.6 else "@sim_low" if ratio > 0.3 else "@sim_none")


def test_split_in_sql_equals_the_column(spark):
    names = ["éÉcole", "naïveÜber1", "XMLHttpRequest", "get_user_name", "", None, "HTML5Doc"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    df.createOrReplaceTempView("names")
    w.register_split(spark)
    got = {}
    for r in spark.sql("SELECT i, word, position FROM names, LATERAL split_identifier_rows(n) ORDER BY i, position").collect():
        got.setdefault(r["i"], []).append(r["word"])
    want = {r[0]: r[1] for r in df.select("i", w.split_identifier(F.col("n"))).collect() if r[1]}
    assert got == want


def test_word_counts_round_trip_and_indented_file(spark, tmp_path):
    counts = spark.createDataFrame([("a", 3), ('q"', 1), ("é", 2), (None, 9)], "word string, cnt long")
    readers.write_word_counts(counts, f"{tmp_path}/c", 1)
    assert sorted(tuple(r) for r in readers.read_word_counts(spark, f"{tmp_path}/c").collect()) == [("a", 3.0), ('q"', 1.0), ("é", 2.0)]
    (tmp_path / "one.json").write_text(json.dumps({"x": 1, "y": 2}, indent=4))
    assert sorted(tuple(r) for r in readers.read_word_counts(spark, f"{tmp_path}/one.json").collect()) == [("x", 1.0), ("y", 2.0)]
    assert readers.read_word_counts(spark, f"{tmp_path}/none").count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("NAME OF,TYPE\nnull,NA\n,x\n")
    assert [tuple(r) for r in readers.read_delimited(spark, f"{tmp_path}/a.csv").collect()] == [("null", "NA"), (None, "x")]
    (tmp_path / "conf.json").write_text('{"script":\n {"port": 5}}')
    assert readers.read_config(spark, f"{tmp_path}/conf.json")["script"]["port"] == 5
    (tmp_path / "w.txt").write_text("A\n\nb,c\n")
    assert [r[0] for r in readers.read_lines(spark, f"{tmp_path}/w.txt").collect()] == ["A", "b,c"]
    assert [r[0] for r in readers.read_word_list(spark, f"{tmp_path}/w.txt").collect()] == ["A", "", "b"]
    (tmp_path / "pipes").mkdir()
    for i in (1, 2):
        (tmp_path / "pipes" / f"{i}.csv").write_text(f"header\nget|V,name{i}|N\nx\n")
    assert sorted(r[0] for r in readers.read_pipe_records(spark, f"{tmp_path}/pipes").collect()) == ["get|V,name1|N", "get|V,name2|N", "x", "x"]
    with pytest.raises(readers.MissingColumns):
        readers.align(spark.range(1), ["id", "x"])
    with pytest.warns(UserWarning):
        assert readers.read_vectors(spark, f"{tmp_path}/no").count() == 0
    (tmp_path / "v.vec").write_text("2 2\na 1 2\nb 3 4.5\n")
    assert sorted((r["word"], r["vec"]) for r in readers.read_vectors(spark, f"{tmp_path}/no", f"{tmp_path}/v.vec").collect()) == [("a", [1, 2]), ("b", [3, 4.5])]
    spark.range(1).write.parquet(f"{tmp_path}/odd")
    with pytest.raises(readers.MissingColumns):
        readers.read_vectors(spark, f"{tmp_path}/odd")
    readers.create_table(spark, "made_here", "a int, b string", "b")
    assert readers.table_exists(spark, "made_here") and not readers.table_exists(spark, "not_made")
    readers.append_report(spark.range(2), f"{tmp_path}/r")
    readers.append_report(spark.range(1), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 3


@pytest.mark.parametrize("sep", [",", "\t"])
def test_delimited_texts_come_back(spark, tmp_path, sep):
    texts = ["a\nb", " sp ", 'q"uote', "a,b", "", None, "x\r\ny", '""', "null", "NA", '"', "\\", 'a\\"b', "tab\tx", ",", "#c", "end\\"]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "i int, a string, `b c` string")
    readers.write_delimited(df, f"{tmp_path}/d", sep=sep)
    got = readers.read_delimited(spark, f"{tmp_path}/d", sep=sep).orderBy(F.col("i").cast("int")).collect()
    assert [(r["a"], r["b_c"]) for r in got] == [(t, t) for t in texts]


def test_neighbours_of_repeated_words(spark):
    rows = core.explode_words(spark.createDataFrame([(["get", "name", "get", "size", "name"],)], "words array<string>").withColumn("split_identifier", F.array_join("words", " ")))
    got = [(r["PREV_POS"], r["NEXT_POS"]) for r in core.featurize(rows, ["PREV_POS", "NEXT_POS"]).orderBy("position").collect()]
    assert got == [("START", "NN"), ("VB", "VB"), ("NN", "NN"), ("VB", "NN"), ("NN", "END")]


def test_cache(spark, tmp_path):
    store = cache.TagCache(spark, str(tmp_path))
    asked = spark.createDataFrame([("a", "x", "CLASS", "2020-01-01 00:00:00"), ("a", "x", "CLASS", "2020-01-03 00:00:00"), ("b", "x", "CLASS", "2020-01-02 00:00:00")], "cache_id string, name string, context string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert store.find("a", "x", "CLASS").count() == 0 and store.lookup(asked).filter("words IS NOT NULL").count() == 0
    store.add(asked.filter("cache_id = 'a'").limit(1).withColumn("words", F.lit("w")))
    assert store.find("a", "x", "CLASS").first()["words"] == "w" and store.find("b", "x", "CLASS").count() == 0
    assert sorted((r["cache_id"], r["words"]) for r in store.lookup(asked).collect()) == [("a", "w"), ("a", "w"), ("b", None)]
    nothing = spark.createDataFrame([("a", None, None, "none")], "cache_id string, name string, context string, words string")
    store.add(nothing)
    assert [r["words"] for r in store.lookup(nothing.drop("words")).collect()] == ["none"] and store.find("a", None, None).first()["words"] == "none"
    store.encounter(asked, "t")
    store.encounter(asked.limit(1), "t")
    assert sorted((r["cache_id"], r["cnt"], r["last_encounter"].day) for r in store.encounters().collect()) == [("a", 3, 3), ("b", 1, 2)]


def test_streams_over_several_runs(spark, tmp_path):
    schema = "name string, context string, cache_id string, ts timestamp"
    rows = [("getName", "FUNCTION", "a", datetime.datetime(2020, 1, 1)), ("x", "CLASS", "b", datetime.datetime(2020, 1, 2))]
    src = f"{tmp_path}/in"
    for _ in range(2):  # what comes later adds to the state
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        encounters.encounter_stream(stream, ["name", "context"], "ts", f"{tmp_path}/state", f"{tmp_path}/log").awaitTermination()
        encounters.tagged_stream(stream, f"{tmp_path}/out", f"{tmp_path}/log2").awaitTermination()
    got = sorted((r["name"], r["cnt"]) for r in encounters.encounter_state(spark, f"{tmp_path}/state", ["name", "context"]).collect())
    assert got == [("getName", 2), ("x", 2)]
    out = spark.read.parquet(f"{tmp_path}/out").filter("cache_id = 'a'").collect()
    assert [r["tags"] for r in out] == [["V", "N"]] * 2


def test_small_operators(spark):
    df = spark.createDataFrame([([("a", 1), ("b", 2), ("a", 3)],)], "p array<struct<word:string,tag:int>>")
    assert df.select(core.last_wins(F.col("p"))).first()[0] == {"a": 3, "b": 2}
    assert [r[0] for r in spark.createDataFrame([(None,), (" ",), ("x",)], "t string").select(core.or_invalid(F.col("t"))).collect()] == ["Invalid", "Invalid", "x"]
    assert spark.range(1).select(F.lit("no json").alias("t")).select(core.read_response(F.col("t"))).first()[0] is None
    assert set(core.stamped(spark.range(1)).columns) == {"id", "tag_time", "tag_time_clock"}
    assert core.drop_features(spark.range(1).select(F.lit(1).alias("Word"), F.lit(2).alias("x"))).columns == ["x"]
    rows = spark.createDataFrame([("get name", "V N"), (" ", "V"), (None, "V"), ("a b", "V"), (" x", None)], "split string, grammar_pattern string")
    assert [r["words"] for r in core.clean_training(rows).collect()] == [["get", "name"]]
    assert len(core.FEATURES) >= 19 and set(lx.DROPPED_FEATURES) == {"SPLIT_IDENTIFIER", "WORD", "MAXPOSITION", "POSITION"}


def test_identifiers_are_tagged_for_the_split_alone(spark, monkeypatch):
    from glossa.operators import tagger
    from glossa.plans import more

    seen, tagged = spark.sparkContext.accumulator(0), more.tagged

    @F.udf("array<string>")
    def counted(x):
        seen.add(1)
        return x

    monkeypatch.setattr(more, "tagged", lambda s, d: tagged(s, d).withColumn("tags", counted("tags")))
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    assert more.sequence_tagger(spark, SF).count() == n and seen.value <= 2 * n  # its counts and its rows
    idents = spark.createDataFrame([(1, ["get", "name"], ["V", "N"]), (2, ["a"], ["DT", "N"]), (3, ["x", "y"], ["N"]), (4, [], []), (5, ["z"], None)], "id long, words array<string>, tags array<string>")
    rows = tagger.word_rows(idents.withColumn("context", F.lit("CLASS")), tags=True).orderBy("id", "position").collect()
    assert [(r["id"], r["word"], r["tag"]) for r in rows] == [(1, "get", "V"), (1, "name", "N"), (2, "a", "DT"), (3, "x", "N"), (3, "y", None)]


def test_equal_identifiers_are_tagged_once_and_all_learned_from(spark, monkeypatch):
    from glossa.operators import tagger

    kinds = [(["get", "name"], ["V", "N"], "CLASS"), (["get", "name"], ["V", "N"], None), (["name"], ["NM"], "CLASS"), ([], [], "CLASS"), (None, None, "CLASS")]
    idents = spark.range(2_300 * len(kinds)).select("id", F.get(F.array(*[F.struct(F.lit(k[0]).cast("array<string>").alias("words"), F.lit(k[1]).cast("array<string>").alias("tags"), F.lit(k[2]).alias("context")) for k in kinds]), (F.col("id") % len(kinds)).cast("int")).alias("x")).select("id", "x.*")
    asked = []

    class Model:
        def transform(self, rows):
            asked.append(rows.count())
            return rows.withColumn("prediction", F.when(F.col("word") == "get", F.lit(lx.TAGS.index("V"))).otherwise(lx.TAGS.index("N")).cast("double"))

    got = Counter((tuple(r["words"] or ()), r["context"], tuple(r["tags"])) for r in tagger.tag(idents, Model()).collect())
    assert asked == [5]  # words of different identifiers
    assert got == {(("get", "name"), "CLASS", ("V", "N")): 2_300, (("get", "name"), None, ("V", "N")): 2_300, (("name",), "CLASS", ("N",)): 2_300, ((), "CLASS", ()): 4_600}
    monkeypatch.setattr(tagger, "fit_tagger", lambda rows, *a, **k: rows)
    rows, _ = tagger.fit_identifier_tagger(idents.filter("size(tags) > 0"))
    assert {lx.TAGS[int(r["label"])]: r["count"] for r in rows.groupBy("label").count().collect()} == {"V": 4_600, "N": 4_600, "NM": 2_300}
