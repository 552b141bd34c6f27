import pytest
from pyspark.sql import functions as F

from glossa.functions import lexicon as lx
from glossa.functions import words as w
from glossa.operators import core as op
from glossa.sources import readers


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize(("name", "want"), [("GLUint", "gl"), ("mData", "m"), ("ABCD", "abc"), ("get", "none"), ("MAX_VALUE", "max")])
def test_hungarian(spark, name, want):
    assert one(spark, w.hungarian_prefix(F.col("x")), x=name) == f"@hung_{want}"


@pytest.mark.parametrize(("word", "want"), [("name", 1.0), ("strings", 6.0), ("xyz", 0.0), ("aeiou", 0.0), ("a1", 0.0)])
def test_ratio(spark, word, want):
    assert one(spark, w.consonant_vowel_ratio(F.col("x")), x=word) == want


@pytest.mark.parametrize(("words", "want"), [(["get", "name"], "low"), (["print", "value"], "mid"), (["string"], "high"), (["xyz"], "high"), (["1", "2"], "none")])
def test_ratio_bucket(spark, words, want):
    assert spark.createDataFrame([(words,)], "x array<string>").select(w.ratio_bucket(F.col("x"))).first()[0] == f"@cvr_{want}"


@pytest.mark.parametrize(("name", "want"), [("XMLHttpRequest", "XML Http Request"), ("parseHTML5Doc", "parse HTML 5 Doc"), ("get_user_name", "get user name"), ("", ""), (None, "")])
def test_split(spark, name, want):
    df = spark.createDataFrame([(name,)], "x string").select(F.array_join(w.split_identifier(F.col("x")), " "))
    assert df.first()[0] == want


def test_labels_and_positions(spark):
    df = spark.createDataFrame([(["V", "NM", "N"],)], "t array<string>")
    assert df.select(w.model_labels(F.col("t"), lx.TAGS)).first()[0] == [-100] * 4 + [-100, 8, -100, 4, -100, 3]
    for n, want in ((1, ["@pos_2"]), (2, ["@pos_0", "@pos_2"]), (3, ["@pos_0", "@pos_1", "@pos_2"])):
        assert one(spark, w.position_tokens(F.lit(n))) == want
    assert one(spark, w.normalize_language(F.col("x")), x="C++") == "@lang_cpp"
    assert one(spark, w.normalize_type(F.col("x")), x="char *") == "@char__ptr"


def test_pattern_prefixes(spark):
    rows = [(p, i) for i, p in enumerate(["V NM N", "V NM N", "V N", "NM N", "P D"])]
    got = dict(tuple(r) for r in op.pattern_prefixes(spark.createDataFrame(rows, "pattern string, ordinal int")).collect())
    assert got == {"V NM N": 2, "V": 1, "NM": 1, "P": 1}


def test_metrics_of_a_known_matrix(spark):
    rows = [("a", "a", 8), ("a", "b", 2), ("b", "a", 1), ("b", "b", 9)]
    m = op.overall(spark.createDataFrame(rows, "actual string, predicted string, cnt long")).first()
    assert m["accuracy"] == pytest.approx(0.85) and m["balanced_accuracy"] == pytest.approx(0.85)
    assert op.multiclass_mcc(spark.createDataFrame(rows, "actual string, predicted string, cnt long")).first()[0] == pytest.approx((8 * 9 - 2) / (10 * 10 * 9 * 11) ** 0.5)


def test_mismatch_policies(spark):
    df = spark.createDataFrame([(["a", "b"], ["V"], "CLASS")], "words array<string>, tags array<string>, context string")
    assert op.training_rows(df).count() == 1
    assert op.training_rows(df, "drop").count() == 0
    with pytest.raises(Exception, match="differ"):
        op.training_rows(df, "error").collect()


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SPLIT IDENTIFIER,GRAMMAR PATTERN\nnull,V\nNA,N\n")
    df = readers.read_delimited(spark, f"file://{tmp_path}/a.csv")
    assert df.columns == ["SPLIT_IDENTIFIER", "GRAMMAR_PATTERN"] and {r[0] for r in df.collect()} == {"null", "NA"}
    with pytest.raises(readers.MissingColumns):
        readers.require_columns(df, ["X"])
    assert readers.read_word_counts(spark, f"file://{tmp_path}/none.json").count() == 0
    (tmp_path / "w.json").write_text('{"get": 2.5, "set": 1}')
    assert dict(tuple(r) for r in readers.read_word_counts(spark, f"file://{tmp_path}/w.json").collect()) == {"get": 2.5, "set": 1.0}


def test_patterns_are_tagged_once(spark):
    from glossa.operators import core
    from pyspark.sql import functions as F

    rows = [("NN VB", 3), ("NN VB", 9), ("NN VB DT", 1), ("NN VB DT IN CC", 7), ("DT NN", 2), ("CC", 5), ("NN CC DT", 8)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    df = spark.createDataFrame(rows, "pattern string, ordinal long").withColumn("pattern", counted("pattern"))
    got = {r["prefix"]: r["freq"] for r in core.pattern_prefixes(df).collect()}
    # the leads are NN VB DT, DT NN and CC
    assert got == {"NN VB": 2 + 1, "NN VB DT": 1, "NN": 1, "DT": 1, "CC": 1} and seen.value == len(rows)


def test_neighbours_by_code(spark):
    from glossa.operators import core
    from pyspark.sql import functions as F

    words = ["The", "Cats", "for", "get", "S", "glass", "Quickly", "tested", "running", "42", "x"]
    df = spark.createDataFrame([(1, words), (2, []), (3, None)], "id long, w array<string>")
    out = core.explode_neighbours(df, F.col("w"))
    got = out.orderBy("pos").collect()
    tags = ["DT", "NNS", "CC", "VB", "NN", "NN", "RB", "VBD", "VBG", "CD", "NN"]
    assert [(r["word"], r["p"]) for r in got] == list(zip(words, tags, strict=True))
    assert [r["prev_pos"] for r in got] == ["START", *tags[:-1]] and [r["next_pos"] for r in got] == [*tags[1:], "END"]
    assert [core.PENN[r["code"]] for r in got] == tags
