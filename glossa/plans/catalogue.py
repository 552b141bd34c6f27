"""Registered queries over the driver's tables, with their SQL.

Identifiers are made from ``part``, words from ``documents``, vectors from ``embeddings``, encounters from
``events`` and predictions from ``labels``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import vectors as v
from ..functions import words as w
from ..operators import core as op
from ..sources.working import written

CONTEXTS = ["FUNCTION", "CLASS", "ATTRIBUTE", "DECLARATION", "PARAMETER"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = BASE + sql
        return fn

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def idents(spark: SparkSession, d: str) -> DataFrame:
    part, n = read(spark, d, "part"), F.split("p_name", " ")
    two = F.try_element_at(n, F.lit(2))
    name = F.concat(n[0], F.upper(F.substring(two, 1, 1)), F.substr(two, F.lit(2)), F.col("p_size"))
    context = F.element_at(F.array(*map(F.lit, CONTEXTS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return part.select(F.col("p_partkey").alias("id"), name.alias("name"), context.alias("context"), "p_brand", "p_type").withColumn("words", w.split_identifier(F.col("name")))


def doc_words(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    return read(spark, d, "documents").select("doc_id", F.posexplode(words).alias("pos", "word"))


def quoted(values) -> str:
    return ", ".join(f"'{x}'" for x in values)


def case(table: dict, key: str, default: str) -> str:
    value = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {value(x)}" for k, x in table.items()) + f" ELSE {default} END"


PENN_SQL = f"""CASE WHEN regexp_full_match(lower(word), '[0-9]+') THEN 'CD' WHEN lower(word) IN ({quoted(lx.CONJUNCTIONS)}) THEN 'CC'
  WHEN lower(word) IN ({quoted(lx.DETERMINERS)}) THEN 'DT' WHEN lower(word) IN ({quoted(lx.PREPOSITIONS)}) THEN 'IN'
  WHEN lower(word) IN ({quoted(lx.VERBS)}) THEN 'VB' WHEN lower(word) LIKE '%ly' THEN 'RB' WHEN lower(word) LIKE '%ing' THEN 'VBG'
  WHEN lower(word) LIKE '%ed' THEN 'VBD' WHEN lower(word) LIKE '%ss' THEN 'NN' WHEN lower(word) LIKE '%s' AND length(word) > 1 THEN 'NNS' ELSE 'NN' END"""

BASE = rf"""
WITH idents AS (
  SELECT *, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '[^\p{{L}}\p{{N}}]+', ' ', 'g'),
      '([\p{{Ll}}0-9])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}}+)(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '(\p{{L}})([0-9])', '\1 \2', 'g')), ' '), lambda x: x <> '') AS words
  FROM (SELECT p_partkey AS id, split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) || p_size AS name,
               [{quoted(CONTEXTS)}][(p_partkey % 5 + 1)::INT] AS context, p_brand, p_type FROM part)),
iw AS (SELECT id, name, context, words, len(words) AS n_words, unnest(words) AS word, unnest(range(0, len(words)))::INT AS position FROM idents),
dw AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words)))::INT AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '\p{{L}}+') AS words FROM documents)),
tagged AS (
  SELECT id, name, context, position, n_words, word, {PENN_SQL} AS penn FROM iw),
tags0 AS (SELECT *, {case(lx.PENN_TAGS, "penn", "'UNKNOWN'")} AS own FROM tagged),
tags AS (
  SELECT *, CASE WHEN own = 'N' AND lead(own, 1, 'END') OVER (PARTITION BY id ORDER BY position) IN ('N', 'NPL', 'NM') THEN 'NM' ELSE own END AS tag FROM tags0),
cm AS (SELECT quality AS actual, toxic AS predicted, count(*) AS cnt FROM labels GROUP BY 1, 2),
cls AS (
  SELECT label, sum(tp)::DOUBLE AS tp, sum(r)::DOUBLE AS r, sum(c)::DOUBLE AS c, (SELECT sum(cnt) FROM cm)::DOUBLE AS n FROM (
    SELECT actual AS label, sum(cnt) AS r, 0 AS c, sum(CASE WHEN actual = predicted THEN cnt ELSE 0 END) AS tp FROM cm GROUP BY 1
    UNION ALL SELECT predicted, 0, sum(cnt), 0 FROM cm GROUP BY 1) GROUP BY label),
met AS (
  SELECT label, tp, c - tp AS fp, r - tp AS fn, n - r - c + tp AS tn, r AS support, n,
         CASE WHEN c = 0 THEN 0 ELSE tp / c END AS precision, CASE WHEN r = 0 THEN 0 ELSE tp / r END AS recall FROM cls),
met2 AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
         (recall + CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END) / 2 AS balanced_accuracy,
         (tp + tn) / (tp + tn + fp + fn) AS weighted_accuracy,
         CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc FROM met)
"""


def tagged(spark: SparkSession, d: str) -> DataFrame:
    return idents(spark, d).withColumn("tags", op.tag_words(F.col("words")))


def split_kinds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(id, kind, is_test) of all identifiers, with 15 % of each last tag held out, and (kind, words, context, tags).

    Equal names in equal contexts are a kind, which is split and tagged once, and not in the few tasks that read
    a small file of many rows.
    """
    rows = idents(spark, d).select("id", "name", "context")
    kinds = rows.select("name", "context").distinct().withColumns({"kind": F.monotonically_increasing_id(), "words": w.split_identifier(F.col("name"))})
    kinds = written(kinds.withColumn("tags", op.tag_words(F.col("words"))), "kinds")
    own = kinds.select("kind", F.col("name").alias("_name"), F.col("context").alias("_context"), F.try_element_at("tags", F.lit(-1)).alias("last"))
    rows = rows.join(own, F.col("name").eqNullSafe(F.col("_name")) & F.col("context").eqNullSafe(F.col("_context")))
    rows = op.stratified_split(written(rows.select("id", "kind", "last"), "rows"), "last", "id", 0.15, 209)
    return written(rows.select("id", "kind", "is_test"), "split"), kinds.drop("name")


@query("SELECT id, name, array_to_string(words, ' ') AS split, len(words)::BIGINT AS n_words FROM idents")
def split_identifiers(spark, d):
    return idents(spark, d).select("id", "name", F.array_join("words", " ").alias("split"), F.size("words").cast("long").alias("n_words"))


@query("SELECT lower(word) AS word, count(*) AS cnt FROM iw GROUP BY 1")
def word_count(spark, d):
    return op.count_by(idents(spark, d).select(F.explode("words").alias("word")), F.lower("word").alias("word"))


@query("SELECT event_type AS context, count(*) AS cnt FROM events GROUP BY 1")
def context_count(spark, d):
    return op.count_by(read(spark, d, "events"), F.col("event_type").alias("context"))


@query(f"SELECT lower(word) AS word, {PENN_SQL} AS tag, count(*) AS cnt FROM dw GROUP BY ALL")
def word_tag_count(spark, d):
    counts = op.count_by(doc_words(spark, d), F.lower("word").alias("word"))  # a word's tag depends on nothing else
    return counts.select("word", op.penn(F.col("word")).alias("tag"), "cnt")


@query(f"""SELECT id, name, n_words::INT AS n_words, position, CASE WHEN position = 0 THEN 0 WHEN position = n_words - 1 THEN 2 ELSE 1 END AS normalized_position,
  {case(lx.CONTEXT_NUMBERS, "context", "0")} AS context_number, lower(word) AS word, tag AS correct_tag FROM tags""")
def training_rows(spark, d):
    return op.training_rows(tagged(spark, d).select("id", "name", "context", "words", "tags")).drop("context")


@query("""SELECT id, position, coalesce(list_position(list_transform(words, lambda x: lower(x)), lower(word)), 0)::INT AS POSITION_1, len(words)::INT AS MAXPOSITION,
  round(list_position(list_transform(words, lambda x: lower(x)), lower(word)) / len(words), 6) AS POSITION_RATIO,
  CASE WHEN lower(word) = lower(words[1]) THEN 0 WHEN lower(word) = lower(words[-1]) THEN 2 ELSE 1 END AS NORMALIZED_POSITION FROM iw""")
def position_features(spark, d):
    rows = op.explode_words(idents(spark, d).withColumn("split_identifier", F.lower(F.array_join("words", " ")))).withColumn("word", F.lower("word")).withColumnRenamed("position", "at")
    rows = op.position_features(rows)
    return rows.select("id", F.col("at").alias("position"), F.col("POSITION").alias("POSITION_1"), "MAXPOSITION", F.round("POSITION_RATIO", 6).alias("POSITION_RATIO"), "NORMALIZED_POSITION")


FLAGS = {"CONTAINSLISTVERB": (lx.VERBS, "lower(word)"), "PREPOSITION": (lx.PREPOSITIONS, "lower(word)"), "CONJUNCTION": (lx.CONJUNCTIONS, "lower(word)"), "DETERMINER": (lx.DETERMINERS, "lower(word)"), "CONTAINSCLOSEDSET": (lx.closed_set(), "word"), "CONTAINSVERB": (lx.VERBS, "word")}


@query("SELECT doc_id, pos, word, " + ", ".join(f"({k} IN ({quoted(x)}))::INT AS {n}" for n, (x, k) in FLAGS.items()) + " FROM dw")
def lexicon_flags(spark, d):
    return op.featurize(doc_words(spark, d), list(FLAGS))


@query(r"""SELECT word, CASE WHEN lower(word) IN (SELECT lower(unnest(string_split(p_name, ' '))) FROM part) THEN 'DW'
  WHEN lower(word) IN (SELECT lower(n_name) FROM nation) THEN 'AW' WHEN regexp_full_match(word, '\p{N}+') THEN 'DD' ELSE 'UC' END AS dictionary
  FROM (SELECT word FROM iw UNION ALL SELECT n_name FROM nation UNION ALL SELECT word FROM dw)""")
def dictionary_class(spark, d):
    english = read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    approved = read(spark, d, "nation").select(F.col("n_name").alias("word"))
    words = op.union_all([idents(spark, d).select(F.explode("words").alias("word")), approved, doc_words(spark, d).select("word")])
    return op.dictionary_class(words, english, approved)


@query(r"""SELECT doc_id, pos, round(CASE WHEN length(regexp_replace(lower(word), '[^aeiou]', '', 'g')) = 0 THEN 0
  ELSE length(regexp_replace(lower(word), '[aeiou]|[^\p{L}]', '', 'g')) / length(regexp_replace(lower(word), '[^aeiou]', '', 'g')) END, 6) AS cvr FROM dw""")
def cvr(spark, d):
    return doc_words(spark, d).select("doc_id", "pos", F.round(w.consonant_vowel_ratio(F.col("word")), 6).alias("cvr"))


BUCKET_SQL = r"""buckets AS (SELECT id, avg(length(regexp_replace(lower(word), '[aeiou]', '', 'g')) / (length(regexp_replace(lower(word), '[^aeiou]', '', 'g')) + 1e-5::DOUBLE))
  FILTER (regexp_full_match(word, '\p{L}+')) AS m FROM iw GROUP BY id)"""
BUCKET = "CASE WHEN m IS NULL THEN '@cvr_none' WHEN m < 1.5 THEN '@cvr_low' WHEN m < 3 THEN '@cvr_mid' ELSE '@cvr_high' END"


@query(f", {BUCKET_SQL} SELECT id, {BUCKET} AS bucket FROM buckets")
def cvr_bucket(spark, d):
    return idents(spark, d).select("id", w.ratio_bucket(F.col("words")).alias("bucket"))


@query("SELECT doc_id, pos, lower(word) LIKE '%s' AND length(word) > 1 AS plural, ascii(lower(right(word, 1)))::INT AS last_letter, ascii(lower(substr(word, greatest(length(word) - 1, 1), 1)))::INT AS second_last_letter FROM dw")
def word_endings(spark, d):
    x = F.col("word")
    return doc_words(spark, d).select("doc_id", "pos", w.is_plural(x).alias("plural"), w.last_letter(x).alias("last_letter"), w.second_last_letter(x).alias("second_last_letter"))


@query("SELECT id, position, word, regexp_full_match(word, '[0-9]+')::INT AS digits, regexp_matches(name, '[0-9]')::INT AS contains_digits FROM iw")
def digit_flags(spark, d):
    rows = op.explode_words(idents(spark, d))
    return rows.select("id", "position", "word", w.is_digits(F.col("word")).alias("digits"), w.has_digits(F.col("name")).alias("contains_digits"))


HUNG = "CASE WHEN regexp_extract({0}, '^([a-zA-Z]{{1,3}})[A-Z_]', 1) = '' THEN '@hung_none' ELSE '@hung_' || lower(regexp_extract({0}, '^([a-zA-Z]{{1,3}})[A-Z_]', 1)) END"


@query("SELECT n_name AS name, " + HUNG.format("n_name") + " AS hungarian FROM nation UNION ALL SELECT substr(p_brand, 1, 1) || name, " + HUNG.format("(substr(p_brand, 1, 1) || name)") + " FROM idents")
def hungarian_prefix(spark, d):
    names = read(spark, d, "nation").select(F.col("n_name").alias("name")).unionByName(idents(spark, d).select(F.concat(F.substring("p_brand", 1, 1), F.col("name")).alias("name")))
    return names.select("name", w.hungarian_prefix(F.col("name")).alias("hungarian"))


EVENT_CONTEXT = {"signup": "CLASS", "purchase": "FUNCTION", "error": "ATTRIBUTE", "view": "DECLARATION", "click": "parameter "}
NAME_OF = {str(n): c for c, n in lx.CONTEXT_NUMBERS.items()}


@query(f"""SELECT event_id, {case(lx.CONTEXT_TOKENS, "upper(trim(c))", "'@unknown'")} AS token, {case(lx.CONTEXT_NUMBERS, "c", "0")} AS number,
  {case(NAME_OF, "CAST(event_id % 7 AS VARCHAR)", "'DEFAULT'")} AS name FROM (SELECT event_id, {case(EVENT_CONTEXT, "event_type", "NULL")} AS c FROM events)""")
def context_codes(spark, d):
    c = lx.lookup(EVENT_CONTEXT, F.col("event_type"), F.lit(None).cast("string"))
    return read(spark, d, "events").select("event_id", lx.context_token(c).alias("token"), lx.context_number(c, 0).alias("number"), lx.context_name((F.col("event_id") % 7).cast("int")).alias("name"))


@query("SELECT id, '@' || replace(replace(lower(trim(p_type || ' *')), '*', '_ptr'), ' ', '_') AS type, '@lang_' || replace(replace(lower(trim(p_brand)), '++', 'pp'), '#', 'sharp') AS language FROM idents")
def normalize_type_lang(spark, d):
    return idents(spark, d).select("id", w.normalize_type(F.concat("p_type", F.lit(" *"))).alias("type"), w.normalize_language(F.col("p_brand")).alias("language"))


@query("""SELECT page_id, replace(regexp_extract(p, '[^/]+$', 0), '.xml_identifiers', 'C++') AS extension,
  coalesce(list_filter(string_split(p, '/'), lambda x: ends_with(x, '.git'))[1], 'unknown') AS system
  FROM (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '/a.git/b.xml_identifiers' ELSE '/c.java' END AS p FROM pages)""")
def path_parts(spark, d):
    path = F.concat("url", F.when(F.col("page_id") % 2 == 0, "/a.git/b.xml_identifiers").otherwise("/c.java"))
    return read(spark, d, "pages").select("page_id", w.file_extension(path, F.lit("C++")).alias("extension"), w.system_name(path).alias("system"))


@query(f"""SELECT doc_id, pos, lag(p, 1, 'START') OVER o AS prev_pos, lead(p, 1, 'END') OVER o AS next_pos, {case(lx.COARSE_NUMBERS, "(" + case(lx.PENN_COARSE, "p", "'NOUN'") + ")", "1")} AS coarse,
  {case(lx.PENN_TAGS, "p", "'UNKNOWN'")} AS tag FROM (SELECT doc_id, pos, {PENN_SQL} AS p FROM dw) WINDOW o AS (PARTITION BY doc_id ORDER BY pos)""")
def pos_neighbors(spark, d):
    words = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    rows = op.explode_neighbours(read(spark, d, "documents").select("doc_id", "text"), words, word=False)
    of = lambda table: F.get(F.array(*map(F.lit, table)), F.col("code"))  # noqa: E731  the lookups are of a few tags, not of each word
    coarse, tag = [lx.COARSE_NUMBERS[lx.PENN_COARSE[p]] for p in op.PENN], [lx.PENN_TAGS[p] for p in op.PENN]
    return rows.select("doc_id", "pos", "prev_pos", "next_pos", of(coarse).alias("coarse"), of(tag).alias("tag"))


SEQ_SQL = f""", {BUCKET_SQL}, feats AS (
  SELECT i.id, words, len(words) AS n, {case(lx.CONTEXT_TOKENS, "context", "'@unknown'")} || ' ' || {HUNG.format("words[1]")} || ' ' || {BUCKET} || ' ' ||
    CASE WHEN regexp_matches(name, '[0-9]') THEN '@has_digit' ELSE '@no_digit' END AS f FROM idents AS i JOIN buckets AS b ON i.id = b.id)"""


@query(SEQ_SQL + """ SELECT id, f AS features, f || ' ' || array_to_string(list_transform(range(1, n + 1), lambda i:
    CASE WHEN i = n THEN '@pos_2' WHEN i = 1 THEN '@pos_0' ELSE '@pos_1' END || ' ' || words[i]), ' ') AS sequence, (4 + 2 * n)::BIGINT AS n_tokens FROM feats""")
def model_sequence(spark, d):
    rows = idents(spark, d)
    tokens = w.model_tokens(F.col("words"), F.col("context"))
    return rows.select("id", F.array_join(w.feature_tokens(F.col("words"), F.col("context")), " ").alias("features"), F.array_join(tokens, " ").alias("sequence"), F.size(tokens).cast("long").alias("n_tokens"))


LABEL_IDS = {t: i for i, t in enumerate(lx.TAGS)}


@query(f"SELECT id, '-100 -100 -100 -100 ' || string_agg('-100 ' || ({case(LABEL_IDS, 'tag', 'NULL')}), ' ' ORDER BY position) AS labels FROM tags GROUP BY id")
def label_sequence(spark, d):
    return tagged(spark, d).select("id", F.array_join(F.transform(w.model_labels(F.col("tags"), lx.TAGS), lambda x: x.cast("string")), " ").alias("labels"))


@query("SELECT id, position, word, substr(word, 1, 4) AS piece FROM iw")
def first_subtoken(spark, d):
    rows = op.explode_words(idents(spark, d)).withColumn("word_idx", 4 + 2 * F.col("position") + 1)
    starts = F.sequence(F.lit(1), F.length("word"), F.lit(4))
    pieces = rows.select("id", "position", "word", "word_idx", F.posexplode(F.transform(starts, lambda i: F.substr("word", i, F.lit(4)))).alias("idx", "piece"))
    return op.first_pieces(pieces).select("id", "position", "word", "piece")


@query(f"SELECT id, string_agg(({case(LABEL_IDS, 'tag', '-100')})::VARCHAR, ' ' ORDER BY position, k) AS labels FROM tags, unnest(range(0, (length(word) + 3) // 4)) AS u(k) GROUP BY id")
def align_labels(spark, d):
    rows = tagged(spark, d)
    ids = F.transform("tags", lambda t: lx.lookup(LABEL_IDS, t, -100))
    of = F.flatten(F.transform("words", lambda x, i: F.array_repeat(i, F.ceil(F.length(x) / 4).cast("int"))))
    return rows.select("id", F.array_join(F.transform(w.piece_labels(of, ids), lambda x: x.cast("string")), " ").alias("labels"))


@query("SELECT conv_id, turn, role AS word, CASE WHEN turn % 3 = 0 THEN 'Unknown' ELSE turn::VARCHAR END AS pos FROM conversations")
def parse_pos_records(spark, d):
    t = F.col("turn").cast("string")
    record = F.concat(F.col("role"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("|"), t)), F.lit(",a|b|c"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.explode(w.parse_pairs(record)).alias("p")).select("conv_id", "turn", "p.word", "p.pos")


@query("SELECT id, coalesce(min_by(tag, position) FILTER (lower(word) = 'widget'), 'NOT_FOUND') AS tag FROM tags GROUP BY id")
def target_tag_lookup(spark, d):
    return tagged(spark, d).select("id", w.tag_of(F.lit("WIDGET"), F.col("words"), F.col("tags")).alias("tag"))


@query("SELECT pattern, count(*) AS cnt FROM (SELECT string_agg(tag, ' ' ORDER BY position) AS pattern FROM tags GROUP BY id) GROUP BY 1")
def pattern_count(spark, d):
    return op.count_by(tagged(spark, d), F.array_join("tags", " ").alias("pattern"))


def sentence_patterns(spark, d):
    """The tags of all words of each sentence of all documents, a sentence's place its ordinal."""
    each = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\.")).alias("k", "s"))
    tags = op.penn_tags(F.regexp_extract_all("s", F.lit(r"\p{L}+"), F.lit(0)))
    each = each.select(tags.alias("tags"), (F.col("doc_id") * 1_000_000 + F.col("k")).alias("ordinal")).filter(F.size("tags") > 0)
    return each.select(F.array_join("tags", " ").alias("pattern"), "ordinal")


@query(rf""", sw AS (
  SELECT doc_id, k, unnest(words) AS word, unnest(range(0, len(words))) AS pos FROM (
    SELECT doc_id, k, regexp_extract_all(s, '\p{{L}}+') AS words FROM (
      SELECT doc_id, unnest(string_split(text, '.')) AS s, unnest(range(0, len(string_split(text, '.')))) AS k FROM documents))),
  pats AS (SELECT string_agg({PENN_SQL}, ' ' ORDER BY pos) AS pattern, doc_id * 1000000 + k AS ordinal FROM sw GROUP BY doc_id, k),
  cnts AS (SELECT pattern, count(*) AS freq, min(ordinal) AS first, string_split(pattern, ' ') AS terms FROM pats GROUP BY pattern),
  leads AS (SELECT terms[1] AS head, arg_min(terms, first) AS lead FROM cnts GROUP BY 1),
  gen AS (SELECT CASE WHEN len(terms) > 1 THEN list_slice(terms, 1, len(terms) - 1) ELSE terms END AS g, lead FROM cnts JOIN leads ON terms[1] = head WHERE freq = 1),
  pre AS (SELECT array_to_string(list_slice(g, 1, coalesce(nullif(list_position(list_transform(list_zip(g, lead), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false), 0) - 1, len(g))), ' ') AS prefix FROM gen)
  SELECT prefix, sum(freq)::BIGINT AS freq FROM (SELECT pattern AS prefix, freq FROM cnts WHERE freq >= 2 UNION ALL SELECT prefix, 1 FROM pre WHERE regexp_matches(prefix, '[\p{{L}}\p{{N}}]')) GROUP BY prefix""")
def pattern_prefix_groups(spark, d):
    return op.pattern_prefixes(sentence_patterns(spark, d))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def collapse_last(spark, d):
    return op.collapse_last(read(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("SELECT id, len(words)::BIGINT AS n, array_to_string(words, ' ') AS split FROM idents WHERE len(words) > 0")
def clean_training_input(spark, d):
    rows = tagged(spark, d).select("id", F.concat(F.lit(" "), F.array_join("words", "  ")).alias("split"), F.array_join("tags", " ").alias("grammar_pattern"))
    return op.clean_training(rows).select("id", F.size("words").cast("long").alias("n"), F.array_join("words", " ").alias("split"))


@query("SELECT doc_id, quality, unnest(CASE WHEN quality = 0 THEN [1, 2, 3] ELSE [1] END) AS copy FROM labels")
def upsample_low_freq(spark, d):
    return op.upsample(read(spark, d, "labels"), F.col("quality") == 0).select("doc_id", "quality", "copy")


@query("SELECT unnest(string_split(p_name, ' ')) AS word FROM part UNION SELECT n_name FROM nation")
def lexicon_union(spark, d):
    return read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).union(read(spark, d, "nation").select("n_name")).distinct()


@query("SELECT unnest(string_split(p_name, ' ')) AS word FROM part EXCEPT SELECT word FROM iw")
def feature_set_diff(spark, d):
    return read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).subtract(idents(spark, d).select(F.explode("words").alias("word")))


@query("SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':209'), doc_id) <= ceil(0.15 * count(*) OVER (PARTITION BY quality)) AS is_test FROM labels")
def stratified_split(spark, d):
    return op.stratified_split(read(spark, d, "labels"), "quality", "doc_id", 0.15, 209).select("doc_id", "quality", "is_test")


@query("SELECT event_id, ((row_number() OVER (ORDER BY md5(event_id || ':209'), event_id) - 1) % 5)::INT AS fold, md5(event_id || ':7') AS shuffled FROM events")
def kfold(spark, d):
    return op.folds(read(spark, d, "events"), "event_id", 5, 209).select("event_id", "fold", op.hash_order(F.col("event_id"), 7).alias("shuffled"))


@query("SELECT doc_id, ((row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':209'), doc_id) - 1) % 5)::INT AS fold FROM labels")
def stratified_kfold(spark, d):
    return op.folds(read(spark, d, "labels"), "doc_id", 5, 209, "quality").select("doc_id", "fold")


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best FROM embeddings")
def argmax(spark, d):
    return read(spark, d, "embeddings").select("vec_id", w.argmax(F.col("embedding")).alias("best"))


def matrix(spark, d):
    return op.confusion(read(spark, d, "labels"), "quality", "toxic")


@query("SELECT actual, predicted, cnt FROM cm")
def confusion_matrix(spark, d):
    return matrix(spark, d)


@query("SELECT actual, coalesce(sum(cnt) FILTER (predicted = 0), 0)::BIGINT AS p0, coalesce(sum(cnt) FILTER (predicted = 1), 0)::BIGINT AS p1 FROM cm GROUP BY actual")
def confusion_pivot(spark, d):
    return op.confusion_pivot(matrix(spark, d), [0, 1]).select("actual", F.col("0").alias("p0"), F.col("1").alias("p1"))


R = ["precision", "recall", "f1", "balanced_accuracy", "weighted_accuracy", "mcc"]


@query("SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, support::BIGINT AS support, " + ", ".join(f"round({c}, 6) AS {c}" for c in R) + " FROM met2")
def per_class_metrics(spark, d):
    return op.per_class(matrix(spark, d)).select("label", "tp", "fp", "fn", "tn", "support", *[F.round(c, 6).alias(c) for c in R])


@query("""SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
  round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
  round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(avg(balanced_accuracy), 6) AS one_vs_rest_balanced_accuracy FROM met2""")
def macro_weighted_metrics(spark, d):
    m = op.overall(matrix(spark, d))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("""SELECT round(CASE WHEN (s * s - pp) * (s * s - tt) = 0 THEN 0 ELSE (c * s - pt) / sqrt((s * s - pp) * (s * s - tt)) END, 6) AS mcc
  FROM (SELECT sum(tp) AS c, sum(support) AS s, sum((tp + fp) * support) AS pt, sum((tp + fp) * (tp + fp)) AS pp, sum(support * support) AS tt FROM met2)""")
def mcc_multiclass(spark, d):
    return op.multiclass_mcc(matrix(spark, d)).select(F.round("mcc", 6).alias("mcc"))


@query("""SELECT round(avg((length(text) % 3 > 0)::INT), 6) AS token_accuracy, count(*) AS n_tokens, round((SELECT avg(ok::INT) FROM (SELECT bool_and(length(text) % 3 > 0) AS ok FROM conversations GROUP BY conv_id)), 6) AS identifier_accuracy FROM conversations""")
def identifier_accuracy(spark, d):
    m = op.all_right(read(spark, d, "conversations"), "conv_id", F.length("text") % 3 > 0)
    return m.select(F.round("token_accuracy", 6).alias("token_accuracy"), "n_tokens", F.round("identifier_accuracy", 6).alias("identifier_accuracy"))


def vecs(spark, d):
    return read(spark, d, "embeddings").withColumnRenamed("embedding", "vec")


def ex(where: str = "") -> str:
    return f", ex AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings {where})"


@query(ex() + ", m AS (SELECT label, i, avg(x) AS m FROM ex GROUP BY ALL) SELECT label, i::INT AS i, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM m")
def centroid(spark, d):
    c = v.centroid(vecs(spark, d), ["label"], unit=True)
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@query(ex() + """, p AS (SELECT i, sum(x * w) FILTER (label = 3) / sum(w) FILTER (label = 3) AS p, avg(x) FILTER (label <> 3) AS n FROM (SELECT *, CASE WHEN vec_id < 50 THEN 5 ELSE 1 END AS w FROM ex) GROUP BY i),
  t AS (SELECT i, p + 0.5 * (p - n) AS t FROM p)
  SELECT vec_id, round(sum(x * t) / (sqrt(sum(x * x)) * sqrt(sum(t * t))), 6) AS score FROM ex JOIN t USING (i) GROUP BY vec_id""".replace("avg(x) FILTER (label <> 3)", "sum(x * w) FILTER (label <> 3) / sum(w) FILTER (label <> 3)"))
def class_score(spark, d):
    return v.class_scores(vecs(spark, d), 3, 0.5, anchor=F.col("vec_id") < 50).select("vec_id", F.round("score", 6).alias("score"))


@query(ex() + ", a AS (SELECT i, x AS y FROM ex WHERE vec_id = 0) SELECT vec_id, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS similarity FROM ex JOIN a USING (i) GROUP BY vec_id")
def anchor_similarity(spark, d):
    x = vecs(spark, d)
    anchor = x.filter("vec_id = 0").select("vec").scalar()  # a second anchor would be an error
    return x.withColumn("anchor", anchor).select("vec_id", F.round(v.cosine(F.col("vec"), F.col("anchor")), 6).alias("similarity"))


@query(ex() + """, m AS (SELECT label, sqrt(sum(m * m)) AS norm FROM (SELECT label, i, avg(x) AS m FROM ex GROUP BY ALL) GROUP BY label)
  SELECT label, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS low, round(max(x), 6) AS high, round(any_value(norm), 6) AS norm FROM ex JOIN m USING (label) GROUP BY label""")
def embedding_stats(spark, d):
    x = vecs(spark, d)
    norms = v.centroid(x, ["label"]).select("label", v.norm(F.col("centroid")).alias("norm"))
    each = x.select("label", F.explode("vec").alias("x")).withColumn("x", F.col("x").cast("double"))
    s = each.groupBy("label").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high")).join(norms, "label")
    return s.select("label", *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high", "norm")])


@query("SELECT hit, count(*) AS cnt FROM (SELECT user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS hit FROM events) GROUP BY hit")
def cache_split(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "event_type")
    hits, misses = op.cache_split(e, e.filter("event_type = 'purchase'"), ["user_id"])
    return hits.withColumn("hit", F.lit(True)).unionByName(misses.withColumn("hit", F.lit(False))).groupBy("hit").agg(F.count("*").alias("cnt"))


ENC = "SELECT user_id, event_type, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS cnt FROM events GROUP BY ALL"


def micros(df: DataFrame) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return df.select("user_id", "event_type", us("first_encounter").alias("first_us"), us("last_encounter").alias("last_us"), "cnt")


@query(ENC)
def encounter_state(spark, d):
    e, keys = read(spark, d, "events"), ["user_id", "event_type"]
    old, new = (op.encounters(e.filter(c), keys, "ts") for c in ("event_id % 2 = 0", "event_id % 2 = 1"))
    return micros(op.merge_encounters(old, new, keys))


@query(ENC)
def encounter_stream(spark, d):
    from ..streaming.encounters import drain

    return micros(drain(spark, d, read(spark, d, "events").schema, ["user_id", "event_type"], "ts"))


@query("""SELECT id, '{"words":[' || string_agg('{"' || word || '":{"tag":"' || tag || '","dictionary":"' || CASE WHEN regexp_full_match(word, '[0-9]+') THEN 'DD' ELSE 'UC' END || '"}}', ',' ORDER BY position) || ']}' AS response FROM tags GROUP BY id""")
def tag_response_json(spark, d):
    kinds = F.transform("words", lambda x: F.when(x.rlike(r"^\p{N}+$"), "DD").otherwise("UC"))
    return tagged(spark, d).select("id", op.tag_response(F.col("words"), F.col("tags"), kinds).alias("response"))


@query()
def prefix_similarity(spark, d):
    return idents(spark, d).select("id", w.similarity_bucket(F.col("words")[0], F.lower(F.col("p_type"))).alias("similarity"))


@query()
def viterbi_decode(spark, d):
    from ..operators.models import viterbi

    whole = F.concat(F.transform("vec", lambda x: x.cast("double")), F.array_repeat(F.lit(float("-inf")), 6))  # 64 components fill six steps and four tags of a seventh
    emissions = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.slice(whole, i * 10 + 1, 10))
    path = viterbi(10)(emissions)
    return vecs(spark, d).select("vec_id", F.array_join(w.decode_labels(path, lx.TAGS), " ").alias("tags"))


@query()
def ml_tagger(spark, d):
    from ..operators.models import fit_tagger

    rows = vecs(spark, d).withColumn("split", F.crc32(F.col("vec_id").cast("string")) % 10 < 7)
    model = fit_tagger(rows.filter("split"), "rf")
    return model.transform(rows).select("vec_id", "label", F.col("prediction").cast("int").alias("prediction"), (~F.col("split")).alias("held_out"))


@query()
def permutation_importance(spark, d):
    from ..operators.models import fit_tagger, permutation_importance

    rows = vecs(spark, d).withColumns({f"x{i}": F.col("vec")[i] for i in range(64)}).drop("vec").withColumnRenamed("vec_id", "id")
    columns = [f"x{i}" for i in range(64)]
    return permutation_importance(fit_tagger(rows, "dt", columns), rows, columns, "label", "id")
