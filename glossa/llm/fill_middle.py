"""Fill-in-the-middle: documents are cut between units and put together again with the middle last.

A text's units are the matches of a pattern, left to right; what no match covers is units of one code point.
They are handled as rows in two steps, so that there is no row for every unit of the corpus: first a row for
each run of ``RUN`` units, with running sums of lengths, which a cut finds by the ordinal of its unit; then a
row for each unit of the runs that hold a cut.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN = 128
CODE_POINT = "(?s:.)"
MARKERS = ("<P>", "<S>", "<M>")
KEY = ["k1", "k2"]


def _group(digest: Column, i: int) -> Column:
    """The i-th group of eight hexadecimal digits as an integer."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _first(piece: Column, n: Column) -> Column:
    return F.substr(piece, F.lit(1), n)


def cut_offsets(texts: DataFrame, cuts: DataFrame, unit: str) -> DataFrame:
    """(k1, k2, n_cut, offset): how many code points the first ``n_cut`` units of a text have.

    ``texts`` has a key of two columns and text, ``cuts`` a row for each key with an array of numbers of units,
    none above the text's. Rows of one key have one text; 0 has no row. Only runs are shuffled, once and by the key.
    """
    plain = unit == CODE_POINT  # then the place of a unit in its run needs no text
    run = f"(?s:.{{1,{RUN}}})" if plain else f"(?:{unit}|{CODE_POINT}){{1,{RUN}}}"
    runs = texts.select(*KEY, F.posexplode(F.regexp_extract_all("text", F.lit(run), F.lit(0))).alias("run", "piece"))
    runs = runs.select(*KEY, "run", F.char_length("piece").alias("chars"), *([] if plain else ["piece"])).repartition(*KEY)
    runs = runs.dropDuplicates([*KEY, "run"])  # a text that is there several times gives its runs several times
    over = Window.partitionBy(*KEY).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("chars").over(over), F.lit(0)))
    # the last unit before a cut is the one of ordinal n_cut - 1
    here = F.filter("cuts", lambda c: (c > F.col("run").cast("long") * RUN) & (c <= (F.col("run").cast("long") + 1) * RUN))
    met = runs.join(cuts.hint("merge"), KEY).select(*runs.columns, F.explode(here).alias("n_cut"))
    met = met.withColumn("within", F.col("n_cut") - F.col("run").cast("long") * RUN)
    if plain:
        return met.groupBy(*KEY, "n_cut").agg(F.max(F.col("before") + F.col("within")).alias("offset"))
    units = F.slice(F.regexp_extract_all("piece", F.lit(f"{unit}|{CODE_POINT}"), F.lit(0)), F.lit(1), F.col("within").cast("int"))
    units = met.select(*KEY, "n_cut", "before", F.explode(units).alias("unit"))
    return units.groupBy(*KEY, "n_cut").agg((F.max("before") + F.sum(F.char_length("unit"))).alias("offset"))


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of this form was made from. Texts with a marker inside are plain, so parts are told apart."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in markers), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_middle(
    docs: DataFrame, unit: str = CODE_POINT, rate: int = 90, spm: int = 20, seed: str = "1", markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output.

    ``rate`` per cent of texts are cut, ``spm`` per cent of these with the suffix first, all drawn from a
    digest of ``seed`` and the id: rows of one id are drawn alike, and a null id as an empty one. Units are
    matches of the regular expression ``unit``, which must neither match nothing nor look around. Null texts
    count as empty; empty texts and those with a marker stay plain. A prefix, middle or suffix may be empty.
    Rows that repeat id and text give equal rows. Other columns are ignored; an empty table gives no rows.
    """
    if re.search(unit, ""):
        raise ValueError("a unit must have a length")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    # a text's key doesn't depend on the order of rows
    rows = rows.select(F.xxhash64("id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "id").alias("k2"), "id", "text")
    n = F.char_length("text") if unit == CODE_POINT else F.regexp_count("text", F.lit(f"{unit}|{CODE_POINT}"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    marked = F.lit(False)
    for m in markers:
        marked |= F.contains("text", F.lit(m))
    rows = rows.withColumns({"n": n.cast("long"), "h": digest})
    plain = (F.col("text") == "") | marked | (_group(F.col("h"), 2) % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(_group(F.col("h"), 3) % 100 < spm, "spm").otherwise("psm"))
    at = [_group(F.col("h"), i) % (F.col("n") + 1) for i in (0, 1)]
    rows = rows.withColumns({"c1": F.least(*at), "c2": F.greatest(*at)})
    cut = rows.filter("form <> 'plain'")
    asked = cut.groupBy(*KEY).agg(F.first(F.array_distinct(F.array("c1", "c2"))).alias("cuts"))
    offsets = cut_offsets(cut.select(*KEY, "text"), asked, unit)
    # one row a document: offsets grow with ordinals; a cut at 0 has no row
    offsets = offsets.groupBy(*KEY).agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
    rows = rows.join(offsets.hint("merge"), KEY, "left")
    high = F.when(F.col("c2") > 0, F.col("high")).otherwise(0)
    low = F.when(F.col("c1") > 0, F.col("low")).otherwise(0)
    rows = rows.withColumns({"a": low.cast("int"), "b": high.cast("int")})
    prefix, middle = _first(F.col("text"), F.col("a")), F.substr("text", F.col("a") + 1, F.col("b") - F.col("a"))
    suffix = F.substr("text", F.col("b") + 1, F.greatest(F.char_length("text") - F.col("b"), F.lit(0)))
    p, s, m = map(F.lit, markers)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    told = F.col("form") != "plain"
    return rows.select(
        F.col("id").alias(id_col), "n", "form", F.when(told, F.col("a").cast("long")).alias("prefix_chars"),
        F.when(told, (F.col("b") - F.col("a")).cast("long")).alias("middle_chars"), output.alias("output"),
    )


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    restored = restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
g AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM d),
f AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS output FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""
