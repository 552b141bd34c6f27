"""The tagger end to end: words, features, a trained model, tags in order, responses."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from .core import FEATURES, featurize, tag_response
from .models import fit_tagger, fit_transitions, viterbi
from .scores import with_scores

PENN_COLUMNS = ("NLTK_POS", "PREV_POS", "NEXT_POS")
COPIES = 1_000  # of one identifier that a row of the fit's shuffle stands for


def word_rows(idents: DataFrame, scored: DataFrame | None = None, key: str = "id", tags: bool = False) -> DataFrame:
    """(key, position, word, the feature columns of a model as doubles) of identifiers (key, words, context).

    With ``tags`` identifiers have tags as well, and rows the tag of their word, so that the two need no join.
    ``scored`` has scores of words, see ``word_scores``; without it those features are left out.
    """
    own = [F.slice("tags", F.lit(1), F.size("words")).alias("tag")] if tags else []
    rows = idents.select(key, F.lower(F.array_join("words", " ")).alias("split_identifier"), lx.context_number(F.col("context"), 0).alias("CONTEXT_NUMBER"), F.posexplode(F.arrays_zip(F.col("words").alias("w"), *own)).alias("position", "_x"))
    own = ["tag"] if tags else []
    rows = rows.withColumns({"word": F.lower("_x.w"), **{c: F.col("_x")[c] for c in own}}).drop("_x")
    scores = [n for n in lx.MODEL_FEATURES if scored is not None and n in scored.columns]
    rows = with_scores(rows, scored.select("word", *scores)) if scores else rows
    names = [n for n in lx.MODEL_FEATURES if n in FEATURES and n not in lx.DROPPED_FEATURES]
    rows = featurize(rows, names)
    number = lambda n: lx.coarse_number(F.col(n)) if n in PENN_COLUMNS else F.col(n)
    columns = [F.coalesce(number(n).cast("double"), F.lit(0.0)).alias(n) for n in [*names, *scores, "CONTEXT_NUMBER"]]
    return rows.select(key, "position", "word", *own, *columns)


def feature_columns(rows: DataFrame, key: str = "id") -> list[str]:
    return [c for c in rows.columns if c not in (key, "position", "word", "label")]


def fit_identifier_tagger(idents: DataFrame, scored: DataFrame | None = None, algorithm: str = "rf", key: str = "id", labels: list[str] = lx.TAGS, **options):
    """(model, log transitions): fitted on identifiers (key, words, tags, context). Words with a tag that is no label are left out.

    Transitions are counts of neighbouring tags, for decoding whole sequences. Features are made once for equal
    identifiers; the fit has their rows as often as they occur.
    """
    of = F.struct("words", "context", "tags")
    kinds = idents.groupBy(of.alias(key)).agg(F.count("*").alias("n")).select(F.struct(f"{key}.*", "n").alias(key))
    rows = word_rows(kinds.select(key, f"{key}.*"), scored, key, tags=True)
    rows = rows.withColumn("label", lx.lookup({t: float(i) for i, t in enumerate(labels)}, F.col("tag"), F.lit(None).cast("double"))).drop("tag").filter("label IS NOT NULL")
    columns, n = feature_columns(rows, key), F.col(f"{key}.n")
    rows = rows.select("label", *columns, F.explode(F.transform(F.sequence(F.lit(0), n - 1, F.lit(COPIES)), lambda i: F.least(n - i, F.lit(COPIES)).cast("int"))).alias("_n"))
    rows = rows.repartition(int(idents.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("_n"))))
    return fit_tagger(rows, algorithm, columns, **options), fit_transitions(idents.select(F.filter("tags", lambda t: t.isin(*labels)).alias("tags")), labels=labels)


def tag(idents: DataFrame, model, scored: DataFrame | None = None, key: str = "id", labels: list[str] = lx.TAGS, transitions=None) -> DataFrame:
    """``idents`` (key, words, context) with tags, one a word: the model's, or with ``transitions`` the best sequence by Viterbi.

    Equal identifiers in equal contexts are tagged once. Identifiers without words have no tags.
    """
    of = F.struct("words", "context")
    out = model.transform(word_rows(idents.select(of.alias(key)).distinct().select(key, f"{key}.*"), scored, key))
    if transitions is None:
        each = F.collect_list(F.struct("position", F.element_at(F.array(*map(F.lit, labels)), (F.col("prediction") + 1).cast("int")).alias("tag")))
        found = out.groupBy(key).agg(F.transform(F.array_sort(each), lambda s: s["tag"]).alias("tags"))
    else:
        logs = F.transform(vector_to_array("probability"), lambda p: F.log(p + 1e-9))
        # a model that has not met the last labels has fewer probabilities
        logs = F.concat(logs, F.array_repeat(F.lit(-1e9), F.greatest(F.lit(len(labels)) - F.size("probability_"), F.lit(0))))
        out = out.withColumn("probability_", vector_to_array("probability")).withColumn("logs", logs)
        found = out.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "logs"))), lambda s: s["logs"]).alias("e"))
        path = viterbi(len(labels), transitions)(F.col("e"))
        found = found.select(key, F.transform(path, lambda i: F.element_at(F.array(*map(F.lit, labels)), i + 1)).alias("tags"))
    found = found.withColumnRenamed(key, "_of")
    return idents.drop("tags").join(found, of == F.col("_of"), "left").drop("_of").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def respond(tagged: DataFrame, kinds: Column, key: str = "id") -> DataFrame:
    """(key, response) of tagged identifiers; ``kinds`` is the dictionary class of each word."""
    return tagged.select(key, tag_response(F.col("words"), F.col("tags"), kinds).alias("response"))
