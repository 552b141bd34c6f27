"""Embedding features of words and identifiers: contrastive class scores, similarity to an anchor word, statistics."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v

# For each score its own class, the classes it is held apart from (one named twice counts twice),
# the anchor word, the shift and the space of vectors.
SCORES = {
    "METHOD_VERB_SCORE": ("VERB", ("NOUN", "CONJUNCTION", "DETERMINER", "PREPOSITION"), "verb", 0.5, "methods"),
    "TOKEN_VERB_SCORE": ("VERB", ("NOUN", "CONJUNCTION", "DETERMINER", "PREPOSITION"), "verb", 0.5, "tokens"),
    "ENGLISH_VERB_SCORE": ("VERB", ("NOUN", "CONJUNCTION", "DETERMINER", "PREPOSITION"), "verb", 0.5, "english"),
    "METHOD_NOUN_SCORE": ("NOUN", ("VERB", "CONJUNCTION", "DETERMINER", "PREPOSITION"), "noun", 0.5, "english"),
    "TOKEN_NOUN_SCORE": ("NOUN", ("VERB", "CONJUNCTION", "DETERMINER", "PREPOSITION"), "noun", 0.5, "english"),
    "ENGLISH_NOUN_SCORE": ("NOUN", ("VERB", "CONJUNCTION", "DETERMINER", "PREPOSITION"), "noun", 0.5, "english"),
    "DET_SCORE": ("DETERMINER", ("NOUN", "VERB", "PREPOSITION", "CONJUNCTION"), "determiner", 0.1, "english"),
    "PREP_SCORE": ("PREPOSITION", ("NOUN", "VERB", "DETERMINER", "CONJUNCTION"), "preposition", 0.1, "english"),
    "CONJ_SCORE": ("CONJUNCTION", ("NOUN", "VERB", "DETERMINER", "PREPOSITION"), "conjunction", 0.1, "english"),
    "CODEPRE_SCORE": ("HUNGARIAN", ("NOUN", "VERB", "DETERMINER", "PREPOSITION", "DETERMINER"), "hungarian notation", 0.1, "tokens"),
    "METHODPRE_SCORE": ("HUNGARIAN", ("NOUN", "VERB", "DETERMINER", "PREPOSITION", "DETERMINER"), "hungarian notation", 0.1, "methods"),
    "ENGLISHPRE_SCORE": ("HUNGARIAN", ("NOUN", "VERB", "DETERMINER", "PREPOSITION", "DETERMINER"), "hungarian notation", 0.1, "english"),
}
ANCHOR_WEIGHT = 5
# Similarity to one word in a space of vectors.
SIMILARITIES = {"METHODV_SCORE": ("verb", "methods"), "ENGLISHV_SCORE": ("verb", "english"), "METHODN_SCORE": ("noun", "methods"), "ENGLISHN_SCORE": ("noun", "english")}
EMBEDDING_COLUMNS = ["EMB_MEAN", "EMB_STD", "EMB_MIN", "EMB_MAX", "EMB_NORM"]


def _members(spark, lexicon: DataFrame, names: list[str]) -> DataFrame:
    """(name, side, word, weight): the words on either side of a score, anchors among them."""
    sides = [(n, s, c, 1.0 * classes.count(c)) for n in names for s, classes in ((1, SCORES[n][:1]), (0, SCORES[n][1])) for c in sorted(set(classes))]
    anchors = [(n, 1, SCORES[n][2], float(ANCHOR_WEIGHT)) for n in names]
    own = lexicon.select("word", "class").distinct().join(F.broadcast(spark.createDataFrame(sides, "name string, side int, class string, weight double")), "class")
    every = own.select("name", "side", "word", "weight").unionByName(spark.createDataFrame(anchors, "name string, side int, word string, weight double"))
    return every.groupBy("name", "side", "word").agg(F.sum("weight").alias("weight"))


def aims(vectors: DataFrame, lexicon: DataFrame, names: list[str]) -> DataFrame:
    """(name, aim): each score's unit centroid shifted away from that of the words it is held apart from.

    ``vectors`` is (word, vec), ``lexicon`` (word, class). Words without a vector are left out; a side without
    any has no centroid, and a score whose own side has none has no aim.
    """
    met = _members(vectors.sparkSession, lexicon, names).join(vectors.select("word", "vec"), "word")
    mean = Summarizer.mean(array_to_vector(F.transform("vec", lambda x: x.cast("double"))), F.col("weight"))
    sides = met.groupBy("name", "side").agg(vector_to_array(mean).alias("m"))
    sides = sides.withColumn("m", F.transform("m", lambda x: F.try_divide(x, v.norm(F.col("m")))))
    both = sides.groupBy("name").agg(F.max(F.when(F.col("side") == 1, F.col("m"))).alias("p"), F.max(F.when(F.col("side") == 0, F.col("m"))).alias("n"))
    beta = F.create_map(*[F.lit(x) for n in names for x in (n, SCORES[n][3])])
    shifted = F.when(F.col("n").isNull(), F.col("p")).otherwise(F.zip_with("p", "n", lambda t, c: t + F.element_at(beta, F.col("name")) * (t - c)))
    return both.select("name", shifted.alias("aim"))


def word_scores(spaces: dict[str, DataFrame], lexicon: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(word, one column a score) for every word of the spaces of vectors that the scores need.

    A vocabulary is scored once, so that rows of words are joined with a few numbers instead of vectors. What
    reaches every task is one vector a score. A word that a space lacks has 0 in its scores.
    """
    names = names or [*SCORES, *SIMILARITIES]
    out = None
    for space in sorted({SCORES[n][4] if n in SCORES else SIMILARITIES[n][1] for n in names}):
        vectors = spaces[space].select("word", "vec").dropDuplicates(["word"])
        own = [n for n in names if n in SCORES and SCORES[n][4] == space]
        near = [n for n in names if n in SIMILARITIES and SIMILARITIES[n][1] == space]
        scored = vectors
        if own:
            table = aims(vectors, lexicon, own).agg(F.map_from_entries(F.collect_list(F.struct("name", "aim")))).scalar()
            scored = scored.withColumn("_aims", table)
            scored = scored.withColumns({n: v.cosine(F.col("vec"), F.try_element_at("_aims", F.lit(n))) for n in own}).drop("_aims")
        for n in near:
            anchor = vectors.filter(F.col("word") == SIMILARITIES[n][0]).select("vec").scalar()
            scored = scored.withColumn("_anchor", anchor).withColumn(n, v.cosine(F.col("vec"), F.col("_anchor"))).drop("_anchor")
        scored = scored.drop("vec")
        out = scored if out is None else out.join(scored, "word", "full")
    return out.na.fill(0.0).select("word", *names)


def with_scores(rows: DataFrame, scored: DataFrame, word: str = "word") -> DataFrame:
    """``rows`` with the scores of their word in lower case, 0 for words that no space has. Null words have 0."""
    names = [c for c in scored.columns if c != "word"]
    out = rows.join(scored.withColumnRenamed("word", "_w"), F.lower(word) == F.col("_w"), "left").drop("_w")
    return out.na.fill(0.0, names)


def embedding_features(rows: DataFrame, vectors: DataFrame, key: str, units: Column) -> DataFrame:
    """(key, EMB_MEAN, EMB_STD, EMB_MIN, EMB_MAX, EMB_NORM) over all components of the vectors of a row's units.

    ``units`` is an array of words, or of characters as the original has it (``F.split(name, "")``). Units
    without a vector are skipped and rows without any have zeros. EMB_NORM is the norm of the mean vector.
    """
    vec = F.transform("vec", lambda x: x.cast("double"))
    sums = vectors.select(
        F.col("word").alias("_unit"), array_to_vector(vec).alias("_v"), F.size("vec").alias("_n"), F.array_min(vec).alias("_low"), F.array_max(vec).alias("_high"),
        F.aggregate(vec, F.lit(0.0), lambda a, x: a + x).alias("_s"), v.dot(F.col("vec"), F.col("vec")).alias("_ss"),
    )
    met = rows.select(key, F.explode(units).alias("_unit")).join(sums, "_unit")
    n, mean = F.sum("_n"), F.sum("_s") / F.sum("_n")
    found = met.groupBy(key).agg(
        mean.alias("EMB_MEAN"), F.sqrt(F.greatest(F.sum("_ss") / n - mean * mean, F.lit(0.0))).alias("EMB_STD"), F.min("_low").alias("EMB_MIN"), F.max("_high").alias("EMB_MAX"),
        v.norm(vector_to_array(Summarizer.mean(F.col("_v")))).alias("EMB_NORM"),
    )
    return rows.select(key).join(found, key, "left").na.fill(0.0, EMBEDDING_COLUMNS)
