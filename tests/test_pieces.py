"""The piece automaton against a slow longest match, and labels on real pieces."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from public_tokenizers import path
from pyspark.sql import functions as F

from glossa.functions import words as w
from glossa.operators import pieces as pc
from glossa.plans import learned
from glossa.plans.catalogue import doc_words

SF = "/root/testdata/sf0.001"


def slow(text, starts, inners):
    out, at = [], 0
    while at < len(text):
        keys = inners if at else starts
        size = next((n for n in range(len(text) - at, 0, -1) if text[at : at + n] in keys), 0)
        if not size:
            return None
        out.append(keys[text[at : at + size]])
        at += size
    return out


words_of = st.text("abc", min_size=1, max_size=5).map(str.encode)


@given(st.lists(words_of, max_size=12, unique=True), st.lists(words_of, max_size=12, unique=True), st.lists(st.text("abc", max_size=14).map(str.encode), max_size=8))
def test_match_equals_longest_first(starts, inners, texts):
    starts = {p: i for i, p in enumerate(starts)}
    inners = {p: 100 + i for i, p in enumerate(inners)}
    one, two = pc.Automaton(starts), pc.Automaton(starts, inners)
    for t in texts:
        assert one.match(t) == slow(t, starts, starts)
        assert two.match(t) == slow(t, starts, inners)


def test_vocabulary_with_inner_pieces(spark):
    rows = [(b"un", 0), (b"##aff", 1), (b"##able", 2), (b"##a", 3), (b"##", 4), (b"", 5), (None, 6), (b"un", 9), (b"get", None)]
    p = pc.pieces_of(spark.createDataFrame(rows, "piece binary, id int"), inner=b"##", special=["@x", "@y", "@x"], unknown=7)
    assert p.special == {"@x": 8, "@y": 9}
    assert [p.encode(x) for x in ["unaffable", "una", "unb", "##", "@y", "", None, "get"]] == [[0, 1, 2], [0, 3], [7], [4], [9], [], [], [7]]
    with pytest.raises(ValueError, match="more than 2"):
        pc.pieces_of(spark.createDataFrame(rows, "piece binary, id int"), most=2)
    with pytest.raises(ValueError, match="no pieces"):
        pc.pieces_of(spark.createDataFrame(rows, "piece binary, id int")).encode("zz")


@pytest.fixture(scope="module")
def given_pieces(spark):
    return pc.pieces_of(pc.read_byte_vocabulary(spark, path("byte_bpe_50k.tiktoken")), lead=b" ", special=["[begin]", "[end]", "@pos_0"])


def test_given_vocabulary(spark, given_pieces):
    keys = {bytes(r["piece"]): r["id"] for r in pc.read_byte_vocabulary(spark, path("byte_bpe_50k.tiktoken")).collect()}
    assert len(keys) == 50256 and given_pieces.special["[begin]"] == 50256
    found = pc.encoded(doc_words(spark, SF), given_pieces).collect()
    assert len(found) > 100 and any(len(r["pieces"]) > 1 for r in found)
    for r in found:
        assert r["pieces"] == slow(b" " + r["word"].encode(), keys, keys)


def test_sequence_and_labels(spark, given_pieces):
    rows = [(1, ["@pos_0", "Employee", "@pos_0", "qzxv"]), (2, []), (3, None), (4, [None, "", "a"]), (5, ["é" * 3000])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>").select("id", given_pieces.sequence(F.col("tokens"), "[begin]", "[end]").alias("s"), F.array(*map(F.lit, [-100, 5, -100, 7])).alias("labels"))
    got = {r["id"]: r for r in df.select("id", "s.*", w.piece_labels(F.col("s.of"), F.col("labels")).alias("labels"), pc.first_of_tokens(F.col("s.of"), F.col("s.pieces")).alias("firsts")).collect()}
    one = got[1]
    parts = [given_pieces.encode(x) for x in rows[0][1]]
    assert len(parts[3]) > 1
    assert one["pieces"] == [50256, *[x for p in parts for x in p], 50257]
    assert one["of"] == [None, *[i for i, p in enumerate(parts) for _ in p], None]
    assert one["labels"] == [-100, *[x for x, p in zip([-100, 5, -100, 7], parts, strict=True) for _ in p], -100]
    assert one["firsts"] == [p[0] for p in parts]
    assert got[2]["pieces"] == got[3]["pieces"] == [50256, 50257]
    assert got[4]["of"][1:-1] == [2] * len(given_pieces.encode("a"))
    assert len(got[5]["pieces"]) > 1000
    cut = df.sparkSession.createDataFrame(rows[:1], "id int, tokens array<string>").select(given_pieces.sequence(F.col("tokens"), "[begin]", "[end]", longest=4).alias("s")).first()["s"]
    assert cut["pieces"] == [50256, *one["pieces"][1:3], 50257]


def test_tagger_on_pieces(spark):
    rows = learned.piece_tagger(spark, SF).collect()
    assert all(len(r["tags"].split()) == len(r["gold"].split()) for r in rows)
    pairs = [p for r in rows if r["is_test"] for p in zip(r["tags"].split(), r["gold"].split(), strict=True)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.8
