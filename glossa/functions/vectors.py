"""Vector functions and centroid scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector lacks or is zero."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def contrast(target: Column, others: Column, beta: float) -> Column:
    """Target shifted away from the mean of the contrast; itself without one."""
    return F.when(others.isNull(), target).otherwise(F.zip_with(target, others, lambda t, c: t + F.lit(beta) * (t - c)))


def centroid(vectors: DataFrame, by: list[str], vec: str = "vec", weight: str | None = None, unit: bool = False) -> DataFrame:
    """Mean vector of each group as (by..., centroid), weighted by a column; of unit length on demand."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    each = array_to_vector(F.transform(vec, lambda x: x.cast("double")))
    mean = Summarizer.mean(each, F.col(weight).cast("double")) if weight else Summarizer.mean(each)
    out = vectors.groupBy(*by).agg(vector_to_array(mean).alias("centroid"))
    if unit:
        out = out.withColumn("centroid", F.transform("centroid", lambda x: F.try_divide(x, norm(F.col("centroid")))))
    return out


def class_scores(vectors: DataFrame, label, beta: float, vec: str = "vec", label_col: str = "label", anchor_weight: int = 5, anchor: Column | None = None) -> DataFrame:
    """``vectors`` with ``score``: cosine with the centroid of one label, shifted away from the mean of the others.

    Rows for which ``anchor`` holds count ``anchor_weight`` times more in the positive centroid.
    """
    w = vectors.withColumn("_weight", F.when(anchor, anchor_weight).otherwise(1) if anchor is not None else F.lit(1))
    both = centroid(w.withColumn("_own", F.col(label_col) == label), ["_own"], vec, "_weight")
    pair = both.agg(F.max(F.when(F.col("_own"), F.col("centroid"))).alias("_p"), F.max(F.when(~F.col("_own"), F.col("centroid"))).alias("_n"))
    aim = pair.select(contrast(F.col("_p"), F.col("_n"), beta)).scalar()
    return vectors.withColumn("_aim", aim).withColumn("score", cosine(F.col(vec), F.col("_aim"))).drop("_aim")


def fetch(words: DataFrame, vectors: DataFrame, dim: int, word: str = "word", vec: str = "vec") -> DataFrame:
    """Words with their vectors, zeros for unknown ones."""
    return words.join(vectors.select(word, vec), word, "left").withColumn(vec, F.coalesce(vec, F.array_repeat(F.lit(0.0).cast("float"), dim)))
