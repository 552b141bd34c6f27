"""Vectors of words that a table of vectors lacks, as the mean of their character n-grams' vectors.

N-grams of the word between ``<`` and ``>`` are hashed to a fixed number of buckets by FNV-1a over their UTF-8 bytes,
taken as signed, modulo the number of buckets, as sub-word vector tables of the common format have it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

SHORTEST, LONGEST, BUCKETS = 3, 6, 2_000_000


def ngrams(word: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """N-grams of ``<word>`` in code points, one entry for each place; without the edges alone. A null or empty word has none."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))
    size = F.char_length(marked)
    of = lambda n: F.transform(
        F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(marked, i, F.lit(n))
    )
    every = F.concat(*[of(n) for n in range(shortest, longest + 1)])
    return F.when(F.char_length(word) > 0, F.filter(every, lambda g: ~g.isin("<", ">"))).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(LongType())
def fnv1a(text: pd.Series) -> pd.Series:
    """32-bit FNV-1a of the UTF-8 bytes, each extended by its sign; a batch's texts are hashed together byte by byte."""
    data = [x.encode() if x is not None else b"" for x in text]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(b"".join(data), np.int8).astype(np.int64)
    starts, out = np.cumsum(sizes) - sizes, np.full(len(data), 2166136261, np.int64)
    rows = np.argsort(-sizes, kind="stable")
    live = len(rows)
    for i in range(int(sizes.max(initial=0))):
        while live and sizes[rows[live - 1]] <= i:
            live -= 1
        at = rows[:live]
        out[at] = ((out[at] ^ (flat[starts[at] + i] & 0xFFFFFFFF)) * 16777619) & 0xFFFFFFFF
    return pd.Series(out).where(text.notna().to_numpy())


def bucket(gram: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(fnv1a(gram), F.lit(buckets))


def word_buckets(words: DataFrame, buckets: int = BUCKETS, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """(word, bucket, n) of a frame of distinct ``word``: how many n-grams of the word fall in the bucket."""
    each = words.select("word", F.explode(ngrams(F.col("word"), shortest, longest)).alias("gram"))
    return each.withColumn("bucket", bucket(F.col("gram"), buckets)).groupBy("word", "bucket").agg(F.count("*").alias("n"))


def subword_vectors(words: DataFrame, table: DataFrame, buckets: int = BUCKETS, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """(word, vec, n_grams) of each distinct word, the mean over its n-grams of the vectors in ``table`` (bucket, vec).

    Buckets without a vector are left out of the mean, and words without one that has are left out. The join is of
    distinct words' n-grams, so that a word that makes up a third of all rows is met once.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    own = word_buckets(words.select("word").filter("word IS NOT NULL").distinct(), buckets, shortest, longest)
    met = own.join(table.select("bucket", array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("_vec")), "bucket")
    out = met.groupBy("word").agg(vector_to_array(Summarizer.mean(F.col("_vec"), F.col("n").cast("double"))).alias("vec"), F.sum("n").alias("n_grams"))
    return out.withColumn("vec", F.col("vec").cast("array<float>"))


def fetch_with_subwords(words: DataFrame, vectors: DataFrame, table: DataFrame, dim: int, buckets: int = BUCKETS, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """``words`` with ``vec``: that of ``vectors`` (word, vec) where it has the word, else the mean of its n-grams, else zeros."""
    known = vectors.filter("vec IS NOT NULL").select("word", F.col("vec").cast("array<float>").alias("_own"))
    distinct = words.select("word").filter("word IS NOT NULL").distinct()
    made = subword_vectors(distinct.join(known, "word", "left_anti"), table, buckets, shortest, longest).select("word", F.col("vec").alias("_own"))
    found = known.join(distinct, "word", "left_semi").unionByName(made)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return words.join(found, "word", "left").withColumn("vec", F.coalesce("_own", zeros)).drop("_own")
