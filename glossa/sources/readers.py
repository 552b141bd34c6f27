"""Typed readers, required columns and writers."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .working import exists

WORD_COUNTS = "word string, log_frequency double"


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself; raises when a column lacks, before any job runs."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise MissingColumns(f"missing columns: {', '.join(lacking)}")
    return df


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly ``columns`` in their order: lacking ones raise, further ones are dropped with a warning."""
    require_columns(df, columns)
    if extra := [c for c in df.columns if c not in columns]:
        warnings.warn(f"dropped columns: {', '.join(extra)}", stacklevel=2)
    return df.select(*columns)


#: How delimited files are written and read: quotes are doubled, blanks kept, null is nothing and empty text two quotes.
DELIMITED = {"quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": "\u0000", "emptyValue": ""}


def read_delimited(spark: SparkSession, path: str, sep: str = ",", infer: bool = False, schema: str | None = None) -> DataFrame:
    """CSV or TSV with a header. Columns are strings unless inferred; the words null and NA stay words; spaces in names become _.

    A field in quotes may hold separators, line ends and doubled quotes, and blanks around a field are its own.
    A field that is empty without quotes is null, with quotes empty. Files are read whole by one task each, as
    line ends may be inside of fields.
    """
    reader = spark.read.options(header=True, sep=sep, inferSchema=infer, **DELIMITED)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[re.sub(r"\s+", "_", c.strip()) for c in df.columns])


def read_sql(spark: SparkSession, statement: str, **views: DataFrame) -> DataFrame:
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement)


def read_config(spark: SparkSession, path: str) -> dict:
    return spark.read.option("multiLine", True).json(path).first().asDict(recursive=True)


def read_word_counts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of counts as (word, log_frequency); a path that names nothing or a broken file gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], WORD_COUNTS)
    text = spark.read.text(path, wholetext=True)
    counts = F.from_json("value", "map<string,double>")
    return text.select(F.explode(counts).alias("word", "log_frequency"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A word a line as it stands; empty lines are left out."""
    return spark.read.text(path).select(F.col("value").alias("word")).filter("word <> ''")


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """The first comma-separated field of each line; lines without a comma are taken whole."""
    return spark.read.text(path).select(F.substring_index("value", ",", 1).alias("word"))


def read_identifier_list(spark: SparkSession, directory: str) -> DataFrame:
    """Fields 1 and 2 of white-space separated lines of *.csv files; short lines give nulls."""
    fields = F.split(F.trim("value"), r"\s+")
    lines = spark.read.option("pathGlobFilter", "*.csv").text(directory)
    return lines.select(F.try_element_at(fields, F.lit(2)).alias("name"), F.try_element_at(fields, F.lit(3)).alias("context"))


def read_pipe_records(spark: SparkSession, path: str) -> DataFrame:
    """Lines of word|POS pairs as record, without the header, the first line of each file. Empty lines are left out."""
    reader = spark.read.option("header", True).option("sep", "\u0001").option("quote", "").option("nullValue", "\u0000")
    return reader.schema("record string").csv(path)


VECTORS = "word string, vec array<float>"


def read_vectors(spark: SparkSession, *paths: str) -> DataFrame:
    """(word, vec) from the first of the paths that is there: Parquet, or text of a word and its numbers a line (.vec, .txt).

    Header lines of two numbers are left out. If none is there are no rows, and a warning; a file of other
    contents raises.
    """
    for path in paths:
        if not exists(spark, path):
            continue
        if re.search(r"\.(vec|txt)(\.\w+)?$", path):
            parts = F.split(F.trim("value"), r"\s+")
            lines = spark.read.text(path).filter(F.size(parts) > 2)
            return lines.select(parts[0].alias("word"), F.slice(parts, 2, F.size(parts)).cast("array<float>").alias("vec"))
        return require_columns(spark.read.parquet(path), ["word", "vec"])
    warnings.warn(f"no vectors at {', '.join(paths) or 'no path'}", stacklevel=2)
    return spark.createDataFrame([], VECTORS)


def write_delimited(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    """Any text comes back from ``read_delimited``: line ends, quotes, separators and blanks; empty text is told from null."""
    options = {**DELIMITED, "nullValue": "", "emptyValue": '""'}
    texts = [F.col(f"`{c}`") for c in df.columns]
    df.select(texts).write.mode("overwrite").options(header=header, sep=sep, **options).csv(path)


def write_word_counts(counts: DataFrame, path: str, words_a_file: int = 100_000) -> None:
    """(word, cnt) as JSON objects of words and counts, one a file, that ``read_word_counts`` reads. Null words are left out."""
    counts = counts.filter("word IS NOT NULL").select("word", "cnt")
    files = max(1, -(-counts.count() // words_a_file))
    each = counts.withColumn("file", F.pmod(F.xxhash64("word"), F.lit(files))).groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("word", "cnt")))).alias("value"))
    each.write.mode("overwrite").partitionBy("file").text(path)


def write_word_lines(pairs: DataFrame, path: str) -> None:
    """Records of (pairs array<struct<word,pos>>) as lines word,pos with an empty line after each record."""
    line = F.concat_ws("\n", F.transform("pairs", lambda p: F.concat_ws(",", p["word"], p["pos"])))
    pairs.select(F.concat(line, F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def append_report(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").json(path)


def create_table(spark: SparkSession, name: str, columns: str, partition: str | None = None) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet" + (f" PARTITIONED BY ({partition})" if partition else ""))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
