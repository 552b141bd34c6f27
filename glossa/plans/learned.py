"""Queries of models that learn sequences and classes, and of splits by a dictionary that the tables give."""

from __future__ import annotations

import numpy as np
from public_tokenizers import path as vocabulary_file
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import words as w
from ..operators import boosting, crf, forests, halving, neighbours, perceptron, pieces, segment, subwords
from ..operators import core as op
from ..sources.working import written
from .catalogue import LABEL_IDS, case, doc_words, query, read, split_kinds, tagged

ROLES = ["assistant", "system", "user"]


# --- words of one case

def document_counts(spark: SparkSession, d: str) -> DataFrame:
    return op.count_by(doc_words(spark, d), F.lower("word").alias("word"))


@query()
def same_case_split(spark, d):
    """Every distinct word of the documents in the pieces that the documents' own counts make most likely."""
    counts = written(document_counts(spark, d), "counts")
    out = segment.segmented(counts, segment.dictionary_of(counts, 2000))
    return out.select("word", F.array_join("pieces", " ").alias("pieces"), F.round("cost", 6).alias("cost"))


# --- sub-word pieces

VOCABULARY = vocabulary_file("byte_bpe_50k.tiktoken")
#: Longest match first: from each place the longest piece of the vocabulary that begins there.
LONGEST_SQL = f"""WITH RECURSIVE vocabulary AS (
    SELECT hex(from_base64(column0)) AS piece, column1::INT AS id FROM read_csv('{VOCABULARY}', delim = ' ', header = false, quote = '', escape = '', columns = {{'column0': 'VARCHAR', 'column1': 'INT'}})),
  todo AS (SELECT DISTINCT word, hex(encode(' ' || word)) AS text FROM own),
  walk AS (
    SELECT word, text, 1::BIGINT AS place, 0 AS k, NULL::INT AS id FROM todo
    UNION ALL SELECT word, text, place + max(length(piece)), k + 1, arg_max(v.id, length(piece)) FROM (
      SELECT word, text, place, k, unnest(range(2, length(text) - place + 2, 2)) AS size FROM walk WHERE place <= length(text)) AS x
    JOIN vocabulary AS v ON v.piece = substr(text, place, size) GROUP BY word, text, place, k),
  cut AS (SELECT word, list(id ORDER BY k) FILTER (k > 0) AS pieces FROM walk GROUP BY word)"""


def piece_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> pieces.Pieces:
    """Pieces of the file; sequences begin and end with tokens of their own, feature and position tokens are one piece each."""
    features = [*lx.CONTEXT_TOKENS.values(), "@unknown", "@cvr_none", "@cvr_low", "@cvr_mid", "@cvr_high", "@has_digit", "@no_digit", "@hung_none", "@pos_0", "@pos_1", "@pos_2"]
    return pieces.pieces_of(pieces.read_byte_vocabulary(spark, path), lead=b" ", special=["[begin]", "[end]", *features])


@query(f"SELECT word, array_to_string(pieces, ' ') AS pieces FROM (WITH own AS (SELECT DISTINCT word FROM dw) SELECT * FROM ({LONGEST_SQL} SELECT * FROM cut))")
def word_pieces(spark, d):
    """Every distinct word of the documents in the longest pieces of a given vocabulary."""
    found = pieces.encoded(doc_words(spark, d), piece_vocabulary(spark))
    return found.select("word", F.array_join(F.col("pieces").cast("array<string>"), " ").alias("pieces"))


@query(f"""SELECT id, string_agg(array_to_string(list_transform(pieces, lambda p: label::VARCHAR), ' '), ' ' ORDER BY position) AS labels,
  string_agg(array_to_string(pieces, ' '), ' ' ORDER BY position) AS pieces, sum(len(pieces))::BIGINT AS n
  FROM (SELECT *, {case(LABEL_IDS, "tag", "-100")} AS label FROM tags)
  JOIN (WITH own AS (SELECT DISTINCT word FROM iw) SELECT * FROM ({LONGEST_SQL} SELECT * FROM cut)) USING (word) GROUP BY id""")
def labelled_pieces(spark, d):
    """Pieces of each identifier's words, each with the label of its word."""
    rows = tagged(spark, d).withColumn("s", piece_vocabulary(spark).sequence(F.col("words")))
    labels = w.piece_labels(F.col("s.of"), F.transform("tags", lambda t: lx.lookup(LABEL_IDS, t, -100)))
    text = lambda c: F.array_join(c.cast("array<string>"), " ")
    return rows.filter(F.size("words") > 0).select("id", text(labels).alias("labels"), text(F.col("s.pieces")).alias("pieces"), F.size("s.pieces").cast("long").alias("n"))


def counted(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """``kinds`` that have rows to learn from, with their number as times."""
    return kinds.join(rows.filter("NOT is_test").groupBy("kind").agg(F.count("*").alias("times")), "kind")


@query()
def piece_tagger(spark, d):
    """Grammar tags as a chain over pieces gives them: feature tokens, positions and words in pieces, a tag a piece, that of a word's first piece.

    Pieces of no word have a tag of their own. Learned from the rules' tags of 85 % of the identifiers.
    """
    rows, kinds = split_kinds(spark, d)
    none, slots = len(lx.TAGS), 1 << 13
    kinds = kinds.withColumn("s", piece_vocabulary(spark).sequence(w.model_tokens(F.col("words"), F.col("context")), "[begin]", "[end]"))
    labels = w.piece_labels(F.col("s.of"), w.model_labels(F.col("tags"), lx.TAGS))
    kinds = kinds.withColumns({"gold": F.col("tags"), "features": pieces.piece_features(F.col("s.pieces"), slots), "of": F.col("s.of")})
    kinds = written(kinds.withColumn("tags", F.transform(labels, lambda x: F.when(x < 0, none).otherwise(x))).drop("s"), "pieces")
    chain, _ = crf.fit_chain(counted(rows, kinds), none + 1, slots, steps=12, tolerance=1e-3)
    # of the tokens' tags, words have those after the feature tokens and a position token each
    found = pieces.first_of_tokens(F.col("of"), F.col("path"))
    found = F.filter(F.slice(found, len(w.TOKEN_FEATURES) + 1, F.greatest(F.size(found), F.lit(1))), lambda x, i: i % 2 == 1)
    out = kinds.withColumn("path", chain.best(F.col("features"))).withColumn("found", found)
    tag = lambda t: F.coalesce(F.get(F.array(*map(F.lit, lx.TAGS)), t), F.lit("UNKNOWN"))
    out = out.select("kind", F.array_join("gold", " ").alias("gold"), F.array_join(F.transform("found", tag), " ").alias("tags"))
    return rows.join(out, "kind").drop("kind")


# --- vectors of unknown words

BUCKETS = 199  # fewer than the rows of the smallest table, whose vectors are those of the buckets
GRAMS_SQL = """grams AS (
    SELECT word, substr(m, i, n) AS gram FROM (SELECT word, '<' || word || '>' AS m FROM own), unnest(range(3, 7)) AS a(n), unnest(range(1, length(m) - n + 2)) AS b(i)),
  hashed AS (
    SELECT gram, (list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(h), 2), lambda i: CASE WHEN substr(h, i, 1) >= '8' THEN 4294967040 ELSE 0 END + ('0x' || substr(h, i, 2))::BIGINT)),
      lambda x, b: (xor(x, b) * 16777619) % 4294967296)) % BUCKETS AS bucket
    FROM (SELECT DISTINCT gram, hex(encode(gram)) AS h FROM grams))""".replace("BUCKETS", str(BUCKETS))


@query(f"SELECT * FROM (WITH own AS (SELECT DISTINCT word FROM dw), {GRAMS_SQL} SELECT word, bucket, count(*) AS n FROM grams JOIN hashed USING (gram) GROUP BY ALL)")
def ngram_buckets(spark, d):
    """Hashed n-grams of three to six letters of every distinct word of the documents, and how many fall in a bucket."""
    return subwords.word_buckets(doc_words(spark, d).select("word").distinct(), BUCKETS)


@query(f"""SELECT * FROM (WITH own AS (SELECT DISTINCT word FROM iw), {GRAMS_SQL},
  known AS (SELECT word, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM own JOIN embeddings ON vec_id = length(word) + {BUCKETS} WHERE word < 'm'),
  parts AS (SELECT word, i, avg(embedding[i]::DOUBLE) AS x FROM grams JOIN hashed USING (gram) JOIN embeddings ON vec_id = bucket, unnest(range(1, 65)) AS r(i)
    WHERE word NOT IN (SELECT word FROM known) GROUP BY ALL),
  made AS (SELECT word, list(x ORDER BY i) AS vec FROM parts GROUP BY word)
  SELECT id, position, word, CASE WHEN known.vec IS NOT NULL THEN 'own' WHEN made.vec IS NOT NULL THEN 'n-grams' ELSE 'none' END AS origin,
    round(coalesce(list_sum(known.vec), list_sum(made.vec), 0), 4) AS total, round(sqrt(coalesce(list_sum(list_transform(known.vec, lambda x: x * x)), list_sum(list_transform(made.vec, lambda x: x * x)), 0)), 4) AS length
  FROM iw LEFT JOIN known USING (word) LEFT JOIN made USING (word))""")
def unknown_word_vectors(spark, d):
    """Vectors of identifiers' words: half of the words have their own, the others the mean of their n-grams' buckets."""
    from ..functions.vectors import norm
    from .catalogue import idents

    rows = written(op.explode_words(idents(spark, d)), "words")
    e = read(spark, d, "embeddings")
    numbered = rows.select("word").distinct().filter("word < 'm'").withColumn("vec_id", F.char_length("word") + BUCKETS)
    known = numbered.join(e, "vec_id").select("word", F.col("embedding").alias("vec"))
    table = e.filter(F.col("vec_id") < BUCKETS).select(F.col("vec_id").alias("bucket"), F.col("embedding").alias("vec"))
    made = subwords.subword_vectors(rows.join(known, "word", "left_anti"), table, BUCKETS).select("word", F.lit(True).alias("made"))
    out = subwords.fetch_with_subwords(rows.select("id", "position", "word"), known, table, 64, BUCKETS)
    out = out.join(known.select("word", F.lit(True).alias("own")), "word", "left").join(made, "word", "left")
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return out.select("id", "position", "word", F.when(F.col("own"), "own").when(F.col("made"), "n-grams").otherwise("none").alias("origin"), F.round(total, 4).alias("total"), F.round(norm(F.col("vec")), 4).alias("length"))


# --- sequences of roles: a turn's role is told by its text and by the turns around it, neither alone

def role_sequences(spark: SparkSession, d: str, slots: int) -> DataFrame:
    """(conv_id, is_test, turns, features, tags): a conversation's turns in order. Features are a turn's words, its length and its first words."""
    slot = lambda name, x: F.pmod(F.xxhash64(F.lit(name), x), F.lit(slots)).cast("int")
    words = F.split(F.trim(F.lower(F.coalesce("text", F.lit("")))), r"\s+")
    long = F.floor(F.log2(F.size("words") + F.lit(1.0)) * 2)
    features = F.concat(F.array(slot("bias", F.lit(0)), slot("long", long), slot("first", F.get("words", F.lit(0)))), F.transform(F.array_distinct("words"), lambda w: slot("word", w)))
    rows = read(spark, d, "conversations").withColumn("words", words)
    number = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1
    each = F.struct("turn", F.array_distinct(features).alias("features"), F.coalesce(number, F.lit(-1)).alias("tag"))
    # a conversation is one sequence, in one task, as a model of whole sequences needs it
    rows = rows.select("conv_id", each.alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    pick = lambda c: F.transform("x", lambda x: x[c]).alias({"turn": "turns", "tag": "tags"}.get(c, c))
    return rows.select("conv_id", (F.crc32(F.col("conv_id").cast("string")) % 4 == 0).alias("is_test"), pick("turn"), pick("features"), pick("tag"))


def _by_turn(rows: DataFrame, path) -> DataFrame:
    each = F.arrays_zip(F.col("turns").alias("turn"), F.col("tags").alias("tag"), path.alias("found"))
    role = lambda c: F.get(F.array(*map(F.lit, ROLES)), c)
    out = rows.select("conv_id", "is_test", F.explode(each).alias("x"))
    return out.select("conv_id", "is_test", F.col("x.turn").alias("turn"), role(F.col("x.tag")).alias("role"), role(F.col("x.found")).alias("predicted"))


@query()
def crf_roles(spark, d):
    """Every turn's role as a conditional random field tells it that has learned from three conversations of four."""
    rows = written(role_sequences(spark, d, 1 << 12), "roles")
    chain, _ = crf.fit_chain(rows.filter("NOT is_test"), len(ROLES), 1 << 12, l2=1.0, steps=12, tolerance=1e-3)
    return _by_turn(rows, chain.best(F.col("features")))


@query()
def perceptron_roles(spark, d):
    """The same by a structured perceptron over the two roles before."""
    rows = written(role_sequences(spark, d, 1 << 12), "roles")
    tagger = perceptron.fit_beam_tagger(rows.filter("NOT is_test"), len(ROLES), 1 << 12, rounds=4)
    return _by_turn(rows, tagger.best(F.col("features")))


@query()
def crf_tagger(spark, d):
    """Grammar tags of all identifiers by a conditional random field that has learned the rules' tags of 85 % of them."""
    rows, kinds = split_kinds(spark, d)
    labels = F.array(*map(F.lit, lx.TAGS))
    kinds = kinds.withColumns({"features": crf.token_features(F.col("words"), F.col("context"), 1 << 12), "gold": F.col("tags")})
    kinds = written(kinds.withColumn("tags", F.transform("gold", lambda t: F.array_position(labels, t).cast("int") - 1)), "features")
    chain, _ = crf.fit_chain(counted(rows, kinds), len(lx.TAGS), 1 << 12, steps=12, tolerance=1e-3)
    found = F.transform(chain.best(F.col("features")), lambda t: F.get(labels, t))
    out = kinds.select("kind", F.array_join("gold", " ").alias("gold"), F.array_join(found, " ").alias("tags"))
    return rows.join(out, "kind").drop("kind")


# --- several classes

LETTERS = "abcdefghijklmnopqrstuvwxyzéèêçàñóíáäöüß"


def letter_shares(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """(doc_id, lang, features, label, is_test) of every document, and the languages of the table."""
    text = F.lower(F.coalesce("text", F.lit("")))
    shares = [(F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))) / F.greatest(F.char_length(text), F.lit(1)) for c in LETTERS]
    docs = read(spark, d, "documents")
    names = sorted(r[0] for r in docs.select("lang").distinct().collect() if r[0] is not None)
    label = F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int") - 1
    rows = docs.select("doc_id", "lang", F.array(*shares).alias("features"), label.alias("label"), (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("is_test"))
    return written(rows, "letters"), names


def _languages(spark: SparkSession, d: str, fit) -> DataFrame:
    rows, names = letter_shares(spark, d)
    model = fit(rows.filter("NOT is_test"), len(names), len(LETTERS))
    found = F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int"))
    return model.transform(rows).select("doc_id", "is_test", "lang", found.alias("predicted"))


@query()
def boosted_languages(spark, d):
    """Every document's language as boosted trees tell it by the shares of letters, learned from three documents of four.

    Documents of no language are told one as well; those without a letter get what has the highest prior.
    """
    return _languages(spark, d, lambda rows, k, n: boosting.fit_boosted(rows, k, n, rounds=4, depth=3))


@query()
def forest_languages(spark, d):
    """The same by extremely randomised trees."""
    return _languages(spark, d, lambda rows, k, n: forests.fit_extra_trees(rows, k, n, trees=20, depth=6))


@query()
def reweighted_languages(spark, d):
    """The same by trees that are boosted by weights of documents."""
    return _languages(spark, d, lambda rows, k, n: forests.fit_reweighted(rows, k, n, rounds=8, depth=3))


@query("""SELECT node::INT AS node, f::INT AS feature, least(greatest(floor((embedding[f + 1]::DOUBLE + 1) * 5), 0), 9)::INT AS bin, label::INT AS class,
  sum(1 + vec_id % 3)::DOUBLE AS w, count(*) AS n FROM (SELECT *, CASE WHEN floor((embedding[1]::DOUBLE + 1) * 5) > 4 THEN 2 ELSE 1 END AS node FROM embeddings), range(64) AS s(f)
  WHERE label BETWEEN 0 AND 9 GROUP BY ALL""")
def class_histograms(spark, d):
    """Weights of rows by class, feature and bin at the two nodes below a split, as trees are grown from them."""
    e = read(spark, d, "embeddings").filter("label BETWEEN 0 AND 9")
    bins = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 5), F.lit(0)), F.lit(9)).cast("int"))
    rows = e.select(bins.alias("bins"), F.col("label").cast("int").alias("label"), (1 + F.col("vec_id") % 3).cast("double").alias("weight"))
    tree = forests.ClassTree(1, classes=10, drawn=np.tile(np.arange(64), (3, 1)))
    tree.feature[0], tree.split[0] = 0, 4
    return forests.class_sums(rows, [tree], 1, 10).select("node", F.col("slot").alias("feature"), "bin", "class", "w", "n")


NEAREST_SQL = """near AS (SELECT q.vec_id AS query, t.vec_id AS key, t.label, list_distance(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(t.embedding, lambda x: x::DOUBLE)) AS distance
    FROM embeddings AS q JOIN embeddings AS t ON q.vec_id % 50 = 0 AND t.vec_id % 50 <> 0),
  first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, key) AS rank FROM near) WHERE rank <= 7),
  votes AS (SELECT query, label, count(*) AS n FROM first GROUP BY ALL)"""


@query(f"""SELECT * FROM (WITH {NEAREST_SQL} SELECT query AS vec_id, string_agg(key::VARCHAR, ' ' ORDER BY rank) AS neighbours, round(max(distance), 6) AS distance,
  any_value(prediction)::INT AS predicted FROM first JOIN (SELECT query, arg_min(label, label - n * 1000) AS prediction FROM votes GROUP BY query) USING (query) GROUP BY query)""")
def nearest_labels(spark, d):
    """The seven vectors closest to each whose number 50 divides, among all others, and the label that most of them have."""
    e = read(spark, d, "embeddings")
    asked = F.col("vec_id") % 50 == 0
    index = neighbours.build_index(e.filter(~asked), "vec_id", "embedding", "label", 64)
    found = written(neighbours.nearest(index, e.filter(asked), "vec_id", "embedding", 7), "found")
    keys = F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"].cast("string"))
    out = found.groupBy("query").agg(F.array_join(keys, " ").alias("neighbours"), F.round(F.max("distance"), 6).alias("distance"))
    return out.join(neighbours.told(found), "query").select(F.col("query").alias("vec_id"), "neighbours", "distance", F.col("prediction").alias("predicted"))


@query()
def halving_table(spark, d):
    """Held-out loss and accuracy of boosted trees for languages by depth, rate and number of rounds, over three folds that share their passes."""
    rows, names = letter_shares(spark, d)
    dealt = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int"))
    return halving.search_boosted(dealt, len(names), len(LETTERS), {"depth": [1, 2], "rate": [0.1, 0.5]}, [1, 3], n_folds=3).table


@query("""SELECT k::INT AS class, f::INT AS feature, least(greatest(floor((embedding[f + 1]::DOUBLE + 1) * 5), 0), 9)::INT AS bin,
  round(sum(0.1::DOUBLE - (label = k)::INT), 6) + 0::DOUBLE AS g, round(count(*) * 0.09::DOUBLE, 6) AS h, count(*) AS n FROM embeddings, range(10) AS r(k), range(64) AS s(f) GROUP BY ALL""")
def gradient_histograms(spark, d):
    """Sums of gradients at the root of a first round, by class, feature and bin of ten equal widths from -1 to 1."""
    e = read(spark, d, "embeddings")
    bins = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 5), F.lit(0)), F.lit(9)).cast("int"))
    rows = e.select(bins.alias("bins"), F.col("label").cast("int").alias("label"), F.array_repeat(F.lit(0.0), 10).alias("scores"))
    out = boosting.histograms(rows, [boosting.Tree(1) for _ in range(10)], 0, 64, 10)
    return out.select("class", "feature", "bin", (F.round("g", 6) + 0.0).alias("g"), F.round("h", 6).alias("h"), "n")
