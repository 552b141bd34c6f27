"""Further queries over the driver's tables with their SQL: embedding features, files, caches, the trained tagger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import vectors as v
from ..functions import words as w
from ..operators import cache, models, scores, tagger
from ..operators import core as op
from ..sources import readers, sqlite
from ..sources.working import scratch, written
from .catalogue import LABEL_IDS, PENN_SQL, case, doc_words, idents, query, quoted, read, split_kinds, tagged

# --- embeddings of words: each word has the vector at a place that its hash names; words whose hash begins with 0 have none

SPACES = ("english", "methods", "tokens")
ANCHORS = sorted({x[2] for x in scores.SCORES.values()} | {x[0] for x in scores.SIMILARITIES.values()})
LISTED = sorted({x for words in lx.LEXICON.values() for x in words} | set(ANCHORS))


def space(spark: SparkSession, d: str, name: str) -> DataFrame:
    known = spark.createDataFrame([(x,) for x in LISTED], "word string")
    every = idents(spark, d).select(F.explode("words").alias("word")).select(F.lower("word").alias("word")).union(known).distinct()
    e = read(spark, d, "embeddings")
    place = F.conv(F.substring(F.md5(F.concat("word", F.lit(f":{name}"))), 1, 8), 16, 10).cast("long") % e.agg(F.count("*")).scalar()
    every = every.filter(F.substring(F.md5("word"), 1, 1) != "0").withColumn("vec_id", place)
    return every.join(e.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("word", "vec")


def values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def members() -> list[tuple]:
    out = {}
    for name, (own, others, anchor, _, _) in scores.SCORES.items():
        for side, classes in ((1, (own,)), (0, others)):
            for c in classes:
                for word in set(lx.LEXICON[c]):
                    out[name, side, word] = out.get((name, side, word), 0) + 1
        out[name, 1, anchor] = out.get((name, 1, anchor), 0) + scores.ANCHOR_WEIGHT
    return [(n, scores.SCORES[n][4], side, word, weight) for (n, side, word), weight in sorted(out.items())]


VECTOR_SQL = f""", voc AS (SELECT DISTINCT lower(word) AS word FROM iw UNION SELECT unnest([{quoted(LISTED)}])),
wv AS (SELECT space, word, embedding FROM (
  SELECT space, word, ('0x' || substr(md5(word || ':' || space), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS place
  FROM voc, (VALUES {values([(x,) for x in SPACES])}) AS s(space) WHERE substr(md5(word), 1, 1) <> '0') JOIN embeddings ON place = vec_id),
wx AS (SELECT space, word, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM wv)"""

NAMES = [*scores.SCORES, *scores.SIMILARITIES]


@query(VECTOR_SQL + f""", mem AS (SELECT * FROM (VALUES {values(members())}) AS m(name, space, side, word, weight)),
  sm AS (SELECT name, space, side, i, sum(weight * x) / sum(weight) AS m FROM mem JOIN wx USING (space, word) GROUP BY ALL),
  su AS (SELECT *, m / sqrt(sum(m * m) OVER (PARTITION BY name, side)) AS u FROM sm),
  aim AS (SELECT name, space, i, max(u) FILTER (side = 1) + ({case({n: x[3] for n, x in scores.SCORES.items()}, "name", "0")}) * (max(u) FILTER (side = 1) - max(u) FILTER (side = 0)) AS t FROM su GROUP BY name, space, i
    UNION ALL SELECT name, space, i, x FROM (VALUES {values([(n, *x) for n, x in scores.SIMILARITIES.items()])}) AS a(name, word, space) JOIN wx USING (space, word)),
  sc AS (SELECT word, name, sum(x * t) / (sqrt(sum(x * x)) * sqrt(sum(t * t))) AS score FROM wx JOIN aim USING (space, i) GROUP BY ALL)
  SELECT iw.id, position, {", ".join(f"round(coalesce(max(score) FILTER (sc.name = '{n}'), 0), 6) AS {n}" for n in NAMES)}
  FROM iw LEFT JOIN sc ON lower(iw.word) = sc.word GROUP BY iw.id, position""")
def class_score_features(spark, d):
    scored = scores.word_scores({x: space(spark, d, x) for x in SPACES}, lx.lexicon_table(spark))
    rows = scores.with_scores(op.explode_words(idents(spark, d)).select("id", "position", "word"), scored)
    return rows.select("id", "position", *[F.round(n, 6).alias(n) for n in NAMES])


@query(VECTOR_SQL + """, u AS (SELECT id, position, x, i FROM iw JOIN wx ON lower(iw.word) = wx.word AND space = 'english'),
  n AS (SELECT id, sqrt(sum(m * m)) AS norm FROM (SELECT id, i, avg(x) AS m FROM u GROUP BY ALL) GROUP BY id),
  g AS (SELECT id, avg(x) AS a, stddev_pop(x) AS b, min(x) AS c, max(x) AS d FROM u GROUP BY id)
  SELECT idents.id, round(coalesce(a, 0), 6) AS EMB_MEAN, round(coalesce(b, 0), 6) AS EMB_STD, round(coalesce(c, 0), 6) AS EMB_MIN, round(coalesce(d, 0), 6) AS EMB_MAX, round(coalesce(norm, 0), 6) AS EMB_NORM
  FROM idents LEFT JOIN g ON idents.id = g.id LEFT JOIN n ON idents.id = n.id""")
def embedding_features(spark, d):
    rows = idents(spark, d)
    out = scores.embedding_features(rows, space(spark, d, "english"), "id", F.transform("words", lambda x: F.lower(x)))
    return out.select("id", *[F.round(c, 6).alias(c) for c in scores.EMBEDDING_COLUMNS])


@query(VECTOR_SQL + " SELECT iw.id, position, round(coalesce(embedding[1], 0)::DOUBLE, 6) AS x0, (embedding IS NOT NULL) AS known FROM iw LEFT JOIN wv ON lower(iw.word) = wv.word AND space = 'english'")
def vector_fetch(spark, d):
    rows = op.explode_words(idents(spark, d)).select("id", "position", F.lower("word").alias("word"))
    out = v.fetch(rows, space(spark, d, "english"), 64)
    return out.select("id", "position", F.round(F.col("vec")[0].cast("double"), 6).alias("x0"), F.exists("vec", lambda x: x != 0).alias("known"))


# --- features, tags and labels

@query(f"""SELECT id, position, lag(penn, 1, 'START') OVER o AS PREV_POS, lead(penn, 1, 'END') OVER o AS NEXT_POS
  FROM (SELECT id, position, {PENN_SQL} AS penn FROM (
    SELECT id, unnest(list_concat(words, words)) AS word, unnest(range(0, 2 * len(words)))::INT AS position FROM idents))
  WINDOW o AS (PARTITION BY id ORDER BY position)""")
def neighbour_features(spark, d):
    """Of identifiers that have each word twice, as names such as get_name_get_size repeat words."""
    rows = idents(spark, d).withColumn("words", F.concat("words", "words"))
    rows = op.explode_words(rows.withColumn("split_identifier", F.array_join("words", " ")))
    return op.featurize(rows, ["PREV_POS", "NEXT_POS"]).select("id", "position", "PREV_POS", "NEXT_POS")


@query("SELECT id, position, lower(word) LIKE '%s' AND length(word) > 1 AS MORPHOLOGICAL_PLURAL FROM iw")
def model_columns(spark, d):
    rows = op.explode_words(idents(spark, d).withColumn("split_identifier", F.array_join("words", " "))).withColumnRenamed("position", "at")
    return op.drop_features(op.featurize(rows, ["MORPHOLOGICAL_PLURAL", "MAXPOSITION", "POSITION"])).select("id", F.col("at").alias("position"), "MORPHOLOGICAL_PLURAL")


@query(f"""SELECT id, unnest(CASE WHEN bool_or(tag IN ({quoted(lx.RARE_TAGS)})) THEN [1, 2, 3] ELSE [1] END) AS copy,
  ((row_number() OVER (ORDER BY md5(id || ':209'), id) - 1) % 5)::INT AS fold FROM tags GROUP BY id""")
def rare_tag_folds(spark, d):
    rows = op.upsample(tagged(spark, d).select("id", "tags"), op.has_rare_tag(F.col("tags")))
    return op.folds(rows, "copy", 5, 209, group="id").select("id", "copy", "fold")


@query(f"SELECT {case(LABEL_IDS, 'tag', '-1')} AS label, count(*) AS cnt FROM tags GROUP BY 1")
def kept_labels(spark, d):
    rows = tagged(spark, d).select(F.explode(w.model_labels(F.col("tags"), lx.TAGS)).alias("label"))
    return op.count_by(op.labelled(rows), "label")


@query("SELECT id, position, tag FROM tags")
def decoded_path(spark, d):
    rows = tagged(spark, d)  # a path over feature and word pieces, without the piece that starts the sequence
    path = F.flatten(F.transform("tags", lambda t: F.array(F.lit("-"), t)))
    at = F.transform("tags", lambda t, i: 2 * (i + 1))
    return rows.select("id", F.posexplode(op.word_labels(path, at)).alias("position", "tag"))


@query("SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'Invalid' ELSE text END AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, '' AS system_name FROM documents")
def request_defaults(spark, d):
    rows = op.with_defaults(read(spark, d, "documents").select("doc_id", "text", "lang", "source"), ["lang", "source", "system_name"])
    return rows.withColumn("text", op.or_invalid(F.col("text")))


@query("SELECT id, position, word, tag, CASE WHEN regexp_full_match(word, '[0-9]+') THEN 'DD' ELSE 'UC' END AS dictionary FROM tags")
def read_tag_response(spark, d):
    kinds = F.transform("words", lambda x: F.when(x.rlike(r"^\p{N}+$"), "DD").otherwise("UC"))
    rows = tagged(spark, d).select("id", op.tag_response(F.col("words"), F.col("tags"), kinds).alias("response"))
    return rows.select("id", F.posexplode(op.read_response(F.col("response"))).alias("position", "x")).select("id", "position", "x.*")


@query("SELECT conv_id, role, arg_max(turn, turn) AS turn FROM conversations GROUP BY ALL")
def last_wins_map(spark, d):
    pairs = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("word"))))
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(pairs.alias("p"))
    made = op.last_wins(F.transform("p", lambda x: F.struct(x["word"].alias("word"), x["turn"].alias("turn"))))
    return rows.select("conv_id", F.explode(made).alias("role", "turn"))


@query("SELECT count(*) AS n, sum(cnt)::BIGINT AS total, max(length(word))::INT AS longest FROM (SELECT lower(word) AS word, count(*) AS cnt FROM dw GROUP BY 1)")
def frequency_totals(spark, d):
    return op.frequency_totals(op.count_by(doc_words(spark, d), F.lower("word").alias("word")), "cnt", "word")


@query("SELECT word, cnt FROM (SELECT lower(word) AS word, count(*) AS cnt FROM dw GROUP BY 1) ORDER BY cnt DESC, word LIMIT 5")
def head_of_counts(spark, d):
    return op.count_by(doc_words(spark, d), F.lower("word").alias("word")).orderBy(F.desc("cnt"), "word").limit(5)


@query(f"SELECT tag AS actual, {case(lx.PENN_TAGS, 'penn', repr('UNKNOWN'))} AS predicted, count(*) AS cnt FROM tags GROUP BY 1, 2")
def align_predictions(spark, d):
    gold = tagged(spark, d).select("id", F.posexplode("tags").alias("position", "actual"))
    own = op.explode_words(idents(spark, d)).select("id", "position", lx.penn_tag(op.penn(F.col("word"))).alias("predicted"))
    return op.confusion(gold.join(own, ["id", "position"]), "actual", "predicted")


@query("SELECT id, position, word FROM iw")
def split_in_sql(spark, d):
    w.register_split(spark)
    idents(spark, d).select("id", "name").createOrReplaceTempView("_names")
    return spark.sql("SELECT id, position, word FROM _names, LATERAL split_identifier_rows(name)")


# --- files, written and read again

@query("SELECT lower(word) AS word, count(*)::DOUBLE AS log_frequency FROM dw GROUP BY 1")
def word_counts_file(spark, d):
    path = scratch(spark, "word-counts")
    readers.write_word_counts(op.count_by(doc_words(spark, d), F.lower("word").alias("word")), path, 5_000)
    return readers.read_word_counts(spark, path)


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_type FROM part")
def delimited_file(spark, d):
    path = scratch(spark, "parts")
    readers.write_delimited(read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), path, sep="\t")
    return readers.align(readers.read_delimited(spark, path, sep="\t"), ["p_partkey", "p_name", "p_brand", "p_type"])


@query("SELECT doc_id::VARCHAR AS doc_id, text, lang, source FROM documents")
def delimited_texts_file(spark, d):
    """Whole texts, with the line ends, quotes, separators and outer blanks that they have."""
    path, columns = scratch(spark, "texts"), ["doc_id", "text", "lang", "source"]
    readers.write_delimited(read(spark, d, "documents").select(*columns), path)
    return readers.read_delimited(spark, path).select(*columns)


@query("SELECT conv_id, role AS word, turn FROM conversations")
def word_lines_file(spark, d):
    path = scratch(spark, "word-lines")
    pairs = F.collect_list(F.struct(F.concat_ws(":", "conv_id", "turn", "role").alias("word"), F.col("role").alias("pos")))
    readers.write_word_lines(read(spark, d, "conversations").groupBy("conv_id").agg(pairs.alias("pairs")), path)
    parts = F.split("word", ":")
    rows = readers.read_word_list(spark, path).filter("word <> ''")
    return rows.select(parts[0].cast("long").alias("conv_id"), parts[2].alias("word"), parts[1].cast("int").alias("turn"))


@query("SELECT name, context FROM idents")
def identifier_list_file(spark, d):
    path = scratch(spark, "identifiers")
    lines = idents(spark, d).select(F.concat_ws("  ", F.lit("int"), "name", "context").alias("value"))
    lines.write.option("quote", "").csv(path)  # its files end in .csv
    return readers.read_identifier_list(spark, path)


@query("SELECT DISTINCT lower(word) AS word FROM dw")
def word_list_file(spark, d):
    path = scratch(spark, "lines")
    doc_words(spark, d).select(F.lower("word").alias("word")).distinct().write.text(path)
    return readers.read_lines(spark, path)


@query("SELECT conv_id::VARCHAR || ':' || turn AS word, role AS pos FROM conversations")
def pipe_records_file(spark, d):
    path = scratch(spark, "pipes")
    record = F.concat(F.concat_ws(":", "conv_id", "turn"), F.lit("|"), F.col("role"))
    read(spark, d, "conversations").select(record.alias("record")).repartition(4).write.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    return readers.read_pipe_records(spark, path).select(F.explode(w.parse_pairs(F.col("record"))).alias("p")).select("p.word", "p.pos")


@query("SELECT n_name AS word, n_regionkey::FLOAT AS x, n_nationkey::FLOAT AS y, 0.5::FLOAT AS z FROM nation WHERE n_name NOT LIKE '% %'")
def vector_text_file(spark, d):
    path = scratch(spark, "vectors") + ".vec"
    n = read(spark, d, "nation").filter("n_name NOT LIKE '% %'")
    n.select(F.concat_ws(" ", "n_name", "n_regionkey", "n_nationkey", F.lit("0.5")).alias("value")).write.text(path)
    x = F.col("vec")
    return readers.read_vectors(spark, path + ".none", path).select("word", x[0].alias("x"), x[1].alias("y"), x[2].alias("z"))


@query("SELECT word, count(*) AS n, min(id)::BIGINT AS first_id, max(position)::BIGINT AS last_position FROM iw WHERE word >= 'D' AND position >= 1 GROUP BY word")
def sqlite_words(spark, d):
    """Words of all identifiers in SQLite files, of which those after the first and from the letter D on are read back."""
    path = scratch(spark, "sqlite")
    rows = op.explode_words(idents(spark, d)).select(F.col("id").cast("long").alias("id"), F.col("position").cast("long").alias("position"), "word")
    sqlite.write_sqlite(rows, path, "words")
    kept = sqlite.read_sqlite(spark, path, "words").filter("word >= 'D' AND position >= 1")
    return kept.groupBy("word").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("position").alias("last_position"))


# --- cache of answers

@query("""SELECT e.event_id, 'tags ' || e.event_type AS words FROM events AS e""")
def cache_lookup(spark, d):
    store = cache.TagCache(spark, scratch(spark, "cache"))
    e = read(spark, d, "events").select("event_id", F.lit("a").alias("cache_id"), F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("context"))
    answers = e.select("cache_id", "name", "context", F.concat(F.lit("tags "), "context").alias("words")).distinct()
    store.add(answers)
    store.add(answers.withColumn("words", F.lit("zz later")))  # the first answer stays
    return store.lookup(e).select("event_id", "words")


@query("SELECT user_id::VARCHAR AS name, event_type AS context, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS cnt FROM events GROUP BY ALL")
def cache_encounters(spark, d):
    store = cache.TagCache(spark, scratch(spark, "cache"))
    e = read(spark, d, "events").select("event_id", F.lit("a").alias("cache_id"), F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("context"), F.col("ts").cast("timestamp").alias("ts"))
    for part in ("event_type = 'purchase'", "event_type <> 'purchase' OR event_type IS NULL"):
        store.encounter(e.filter(part), "ts")
    us = lambda c: F.unix_micros(F.col(c))
    return store.encounters().select("name", "context", us("first_encounter").alias("first_us"), us("last_encounter").alias("last_us"), "cnt")


def user_requests(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", "event_type", F.lit("a").alias("cache_id"), F.col("user_id").cast("string").alias("name"), F.lit("USER").alias("context"), F.col("ts").cast("timestamp").alias("ts"))


@query("SELECT user_id::VARCHAR AS name, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS cnt FROM events GROUP BY ALL")
def compacted_encounters(spark, d):
    """Encounters in a batch a kind of event and every batch sent twice, as merged runs of two levels or more."""
    store = cache.TagCache(spark, scratch(spark, "cache"), buckets=4, fan=2)
    e = user_requests(spark, d)
    kinds = sorted(r[0] or "" for r in e.select("event_type").distinct().collect())
    for i, kind in enumerate(kinds):
        for _ in range(2):  # counted once
            store.encounter(e.filter(F.coalesce("event_type", F.lit("")) == kind), "ts", "kinds", i)
    us = lambda c: F.unix_micros(F.col(c))
    return store.encounters().select("name", us("first_encounter").alias("first_us"), us("last_encounter").alias("last_us"), "cnt")


@query("""SELECT event_id, 'user ' || user_id AS words, b AND n > 0 AS hit, CASE WHEN b AND n > 0 THEN n END AS cnt, CASE WHEN b AND n > 0 THEN t END AS first_us
  FROM (SELECT *, event_type IS DISTINCT FROM 'purchase' AS b, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS n,
    epoch_us(min(ts) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id)) AS t FROM events)""")
def answered_requests(spark, d):
    """Requests for a user's tag, purchases first: a batch's misses are tagged once a key; hits tell what had been seen before the batch."""
    from ..streaming.encounters import answer_batch

    store = cache.TagCache(spark, scratch(spark, "cache"))
    e, tag, first = user_requests(spark, d), F.concat(F.lit("user "), "name"), F.col("event_type").eqNullSafe("purchase")
    parts = [answer_batch(store, e.filter(p), "ts", tag, "requests", i) for i, p in enumerate((first, ~first))]
    return op.union_all(parts).select("event_id", "words", "hit", "cnt", F.unix_micros("first_encounter").alias("first_us"))


# --- the trained tagger and model selection

def trained(spark, d, algorithm="rf"):
    vectors = written(space(spark, d, "english"), "space")
    scored = scores.word_scores({"english": vectors}, lx.lexicon_table(spark), ["ENGLISHPRE_SCORE", "PREP_SCORE", "DET_SCORE", "ENGLISH_VERB_SCORE", "CONJ_SCORE", "ENGLISH_NOUN_SCORE"])
    scored = written(scored, "scores")
    rows, kinds = split_kinds(spark, d)
    rows = written(rows.join(kinds, "kind").drop("kind"), "tagged")  # the fit, the transitions and the tagging read them
    model, transitions = tagger.fit_identifier_tagger(rows.filter("NOT is_test"), scored, algorithm)
    return rows, scored, model, transitions


@query()
def identifier_tagger(spark, d):
    """Fitted on the rules' tags of 85 % of the identifiers, then all are tagged and answered."""
    rows, scored, model, _ = trained(spark, d)
    out = tagger.tag(rows.withColumnRenamed("tags", "gold"), model, scored)
    kinds = F.transform("words", lambda x: F.when(x.rlike(r"^\p{N}+$"), "DD").otherwise("UC"))
    out = out.withColumn("response", op.tag_response(F.col("words"), F.col("tags"), kinds))
    return out.select("id", "is_test", F.array_join("gold", " ").alias("gold"), F.array_join("tags", " ").alias("tags"), "response")


@query()
def sequence_tagger(spark, d):
    """The same with a model's probabilities and transitions, decoded as whole sequences."""
    rows, scored, model, transitions = trained(spark, d, "dt")
    out = tagger.tag(rows.withColumnRenamed("tags", "gold"), model, scored, transitions=transitions)
    return out.select("id", "is_test", F.array_join("gold", " ").alias("gold"), F.array_join("tags", " ").alias("tags"))


@query()
def grid_search_table(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")
    return models.grid_search(rows, "vec_id", {"maxDepth": [3, 7], "minInstancesPerNode": [1, 5]}, "dt", k=3)[1]
