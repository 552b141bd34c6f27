"""Operators over frames of identifiers, words, tags, predictions and encounters."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import words as w
from ..sources.readers import require_columns
from ..sources.working import written


# --- words, positions, features

def explode_words(idents: DataFrame, words: str = "words") -> DataFrame:
    """A row a word with POSITION from 0, WORD and the number of words."""
    return idents.select("*", F.size(words).alias("n_words"), F.posexplode(words).alias("position", "word")).drop(words)


def training_rows(idents: DataFrame, mismatch: str = "truncate") -> DataFrame:
    """A row a word of (words, tags, context): position, normalized_position by index, context_number, word, correct_tag.

    Words and tags of unequal number are dropped, raise, or are cut to the shorter.
    """
    require_columns(idents, ["words", "tags", "context"])
    n = F.least(F.size("words"), F.size("tags"))
    if mismatch == "drop":
        idents = idents.filter(F.size("words") == F.size("tags"))
    elif mismatch == "error":
        n = F.when(F.size("words") == F.size("tags"), n).otherwise(F.raise_error(F.lit("words and tags differ in number")).cast("int"))
    pairs = F.arrays_zip(F.slice("words", 1, n).alias("word"), F.slice("tags", 1, n).alias("correct_tag"))
    rows = idents.withColumn("n_words", F.size("words")).select("*", F.posexplode(pairs).alias("position", "_p"))
    place = F.when(F.col("position") == 0, 0).when(F.col("position") == F.col("n_words") - 1, 2).otherwise(1)
    return rows.select(*[c for c in idents.columns if c not in ("words", "tags")], "n_words", "position", place.alias("normalized_position"), lx.context_number(F.col("context"), 0).alias("context_number"), F.lower("_p.word").alias("word"), F.col("_p.correct_tag").alias("correct_tag"))


def position_features(rows: DataFrame) -> DataFrame:
    """POSITION, MAXPOSITION, POSITION_RATIO and NORMALIZED_POSITION by value from (word, split_identifier)."""
    words = F.split(F.lower(F.trim("split_identifier")), r"\s+")
    place = F.when(F.col("word") == words[0], 0).when(F.col("word") == F.element_at(words, -1), 2).otherwise(1)
    at = F.array_position(words, F.col("word")).cast("int")
    return rows.withColumns({"POSITION": at, "MAXPOSITION": F.size(words), "POSITION_RATIO": F.coalesce(F.try_divide(at, F.size(words)), F.lit(0.0)), "NORMALIZED_POSITION": place})


def _in(name: str, lower: bool = True) -> Callable[[], Column]:
    return lambda: F.coalesce((F.lower("word") if lower else F.col("word")).isin(*lx.LEXICON[name]), F.lit(False)).cast("int")


def _place(i: int) -> Callable[[], Column]:
    return lambda: [F.array_position(F.split(F.lower(F.trim("split_identifier")), r"\s+"), F.col("word")).cast("int"), F.size(F.split(F.trim("split_identifier"), r"\s+"))][i]


#: Features by name, each a column over (word, split_identifier).
FEATURES: dict[str, Callable[[], Column]] = {
    "POSITION": _place(0),
    "MAXPOSITION": _place(1),
    "POSITION_RATIO": lambda: F.coalesce(F.try_divide(_place(0)(), _place(1)()), F.lit(0.0)),
    "NORMALIZED_POSITION": lambda: F.when(F.col("word") == F.split(F.lower(F.trim("split_identifier")), r"\s+")[0], 0).when(F.col("word") == F.element_at(F.split(F.lower(F.trim("split_identifier")), r"\s+"), -1), 2).otherwise(1),
    "CONTAINSLISTVERB": _in("VERB"),
    "PREPOSITION": _in("PREPOSITION"),
    "CONJUNCTION": _in("CONJUNCTION"),
    "DETERMINER": _in("DETERMINER"),
    "CONTAINSCLOSEDSET": lambda: F.col("word").isin(*lx.closed_set()).cast("int"),
    "CONTAINSVERB": _in("VERB", lower=False),
    "DIGITS": lambda: w.is_digits(F.col("word")),
    "CONTAINSDIGITS": lambda: w.has_digits(F.col("split_identifier")),
    "LAST_LETTER": lambda: w.last_letter(F.col("word")),
    "SECOND_LAST_LETTER": lambda: w.second_last_letter(F.col("word")),
    "MORPHOLOGICAL_PLURAL": lambda: w.is_plural(F.col("word")),
    "CONSONANT_VOWEL_RATIO": lambda: w.consonant_vowel_ratio(F.col("word")),
    "NLTK_POS": lambda: penn(F.col("word")),
}


def _beside(step: int, edge: str) -> Callable[[], Column]:
    """The Penn tag of the word before or after, or the edge's mark: by the row's position (from 0) in its identifier."""

    def column() -> Column:
        other = F.get(F.split(F.trim("split_identifier"), r"\s+"), F.col("position") + step)
        return F.when(other.isNull(), edge).otherwise(penn(other))

    return column


#: These need a row's position as well, since an identifier may repeat a word.
FEATURES |= {"PREV_POS": _beside(-1, "START"), "NEXT_POS": _beside(1, "END")}


def register_feature(name: str, fn: Callable[[], Column]) -> None:
    FEATURES[name] = fn


def featurize(rows: DataFrame, names: list[str]) -> DataFrame:
    """All features in one projection; unknown names only warn."""
    for n in names:
        if n not in FEATURES:
            warnings.warn(f"unknown feature {n}", stacklevel=2)
    return rows.withColumns({n: FEATURES[n]() for n in names if n in FEATURES})


def drop_features(rows: DataFrame, names: list[str] = lx.DROPPED_FEATURES) -> DataFrame:
    """``rows`` without the columns that a model must not learn from, whatever the case of their names; others need not be there."""
    gone = {n.lower() for n in names}
    return rows.select(*[c for c in rows.columns if c.lower() not in gone])


def dictionary_class(words: DataFrame, english: DataFrame, approved: DataFrame, word: str = "word") -> DataFrame:
    """``words`` with ``dictionary``: DW English, AW approved, DD numeric, else UC. The lists have a ``word`` column."""
    e = english.select(F.lower("word").alias("_w"), F.lit(1).alias("_e"), F.lit(None).cast("int").alias("_a"))
    a = approved.select(F.lower("word").alias("_w"), F.lit(None).cast("int").alias("_e"), F.lit(1).alias("_a"))
    lists = e.unionByName(a).groupBy("_w").agg(F.max("_e").alias("_e"), F.max("_a").alias("_a"))
    out = words.withColumn("_w", F.lower(word)).join(lists, "_w", "left")
    kind = F.when(F.col("_e").isNotNull(), "DW").when(F.col("_a").isNotNull(), "AW").when(F.col(word).rlike(r"^\p{N}+$"), "DD").otherwise("UC")
    return out.withColumn("dictionary", kind).drop("_w", "_e", "_a")


# --- tagging

#: What ``penn`` gives, by code.
PENN = ["NN", "NNS", "VBD", "VBG", "RB", "VB", "IN", "DT", "CC", "CD"]


def _penn(word: Column, low: Column, as_code: bool = False) -> Column:
    x = {t: F.lit(i if as_code else t) for i, t in enumerate(PENN)}
    digits = F.when(F.substring(word, -1, 1).between("A", "z"), False).otherwise(word.rlike(r"^\p{Nd}+$"))  # most words end in a letter
    closed = F.when(low.isin(*lx.CONJUNCTIONS), x["CC"]).when(low.isin(*lx.DETERMINERS), x["DT"]).when(low.isin(*lx.PREPOSITIONS), x["IN"]).otherwise(x["VB"])
    plural = F.when(low.endswith("ss"), x["NN"]).when(F.length(low) > 1, x["NNS"]).otherwise(x["NN"])
    return (
        F.when(digits, x["CD"]).when(low.isin(*lx.closed_set(), *lx.VERBS), closed)  # few words are in a list: one look tells
        .when(low.endswith("ly"), x["RB"]).when(low.endswith("ing"), x["VBG"]).when(low.endswith("ed"), x["VBD"]).when(low.endswith("s"), plural).otherwise(x["NN"])
    )


def penn(word: Column) -> Column:
    """Penn tag by word lists and endings; the slot that a model's tagger may fill."""
    return _penn(word, F.lower(word))


def penn_tags(words: Column, as_code: bool = False) -> Column:
    """The Penn tag of each word of an array, or its place in ``PENN``. Functions of array elements are not compiled, so each word is put in lower case once."""
    low = lambda w: F.struct(w.alias("w"), F.lower(w).alias("l"))
    return F.transform(F.transform(words, low), lambda s: _penn(s["w"], s["l"], as_code))


def tag_words(words: Column) -> Column:
    """Tags by rule: the word's own, and a noun before another noun modifies it."""
    own = F.transform(penn_tags(words), lx.penn_tag)
    after = F.concat(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), F.array(F.lit("END")))
    return F.zip_with(own, after, lambda t, n: F.when((t == "N") & n.isin("N", "NPL", "NM"), "NM").otherwise(t))


def with_neighbours(rows: DataFrame, pos: str = "pos", by: str = "identifier_id", order: str = "position") -> DataFrame:
    """Rows that are apart already; a group's words are in one task. Words still in an array need no shuffle, see ``explode_neighbours``."""
    over = Window.partitionBy(by).orderBy(order)
    return rows.withColumns({"prev_pos": F.lag(pos, 1, "START").over(over), "next_pos": F.lead(pos, 1, "END").over(over)})


def explode_neighbours(rows: DataFrame, words: Column, word: bool = True) -> DataFrame:
    """A row a word: pos from 0, word (unless left out), the Penn tags of the word, the one before (START) and the one after (END), and the word's code in ``PENN``."""
    tags = rows.withColumn("_w", words).withColumn("_t", penn_tags(F.col("_w"), as_code=True))
    n, edge = F.greatest(F.size("_t") - 1, F.lit(0)), lambda i: F.array(F.lit(len(PENN) + i))
    before, after = F.concat(edge(0), F.slice("_t", 1, n)), F.concat(F.slice("_t", 2, n), edge(1))
    own = [F.col("_w").alias("w")] if word else []
    each = F.when(F.size("_t") > 0, F.arrays_zip(*own, F.col("_t").alias("t"), before.alias("b"), after.alias("a")))
    out = tags.select(*rows.columns, F.posexplode(each).alias("pos", "_x"))
    name = lambda c: F.get(F.array(*map(F.lit, [*PENN, "START", "END"])), F.col(f"_x.{c}"))
    own = [F.col("_x.w").alias("word")] if word else []
    return out.select(*rows.columns, "pos", *own, name("t").alias("p"), name("b").alias("prev_pos"), name("a").alias("next_pos"), F.col("_x.t").alias("code"))


def tag_response(words: Column, tags: Column, kinds: Column) -> Column:
    """{"words": [{word: {"tag", "dictionary"}}, ...]} as JSON."""
    each = F.transform(F.arrays_zip(words.alias("w"), tags.alias("t"), kinds.alias("d")), lambda s: F.create_map(s["w"], F.struct(s["t"].alias("tag"), s["d"].alias("dictionary"))))
    return F.to_json(F.struct(each.alias("words")))


RESPONSE = "words array<map<string,struct<tag:string,dictionary:string>>>"


def read_response(text: Column) -> Column:
    """The words of a response as an array of (word, tag, dictionary); null for text that is none."""
    each = F.transform(F.from_json(text, RESPONSE)["words"], lambda m: F.map_entries(m)[0])
    return F.transform(each, lambda e: F.struct(e["key"].alias("word"), e["value"]["tag"].alias("tag"), e["value"]["dictionary"].alias("dictionary")))


def last_wins(pairs: Column) -> Column:
    """A map of an array of two-field structs; of equal keys the last one's value stays."""
    keys = F.transform(pairs, lambda p: p["word"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["word"])))


def word_labels(path: Column, word_pieces: Column) -> Column:
    """Labels of words from a decoded path that lacks the start piece: the label of piece i is path[i - 1]."""
    return F.transform(word_pieces, lambda i: F.try_element_at(path, i.cast("int")))


def first_pieces(pieces: DataFrame, features: int = 4) -> DataFrame:
    """First sub-token of each word, without special, feature and position tokens; columns id, idx, word_idx."""
    odd = pieces.filter((F.col("word_idx") >= features) & ((F.col("word_idx") - features) % 2 == 1))
    return odd.withColumn("_r", F.row_number().over(Window.partitionBy("id", "word_idx").orderBy("idx"))).filter("_r = 1").drop("_r")


# --- counts and patterns

def count_by(rows: DataFrame, *keys: Column | str, name: str = "cnt") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def frequency_totals(rows: DataFrame, name: str = "freq", word: str | None = None) -> DataFrame:
    """One row: the number of rows, the sum of their frequencies and, of a text column, the longest length."""
    more = [F.max(F.length(word)).alias("longest")] if word else []
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(name), F.lit(0)).alias("total"), *more)


def collapse_last(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("_r")).select(key, "_r.*")


def pattern_prefixes(patterns: DataFrame) -> DataFrame:
    """(pattern, ordinal) to (prefix, freq): patterns seen twice or more keep their count; each other one counts for the
    common prefix of its generalisation with the earliest pattern of the same first term. Patterns without a letter or digit are left out.

    Patterns are counted once and written, since they are read three times. First terms are from a set of tags, so that
    what is sent to every task is a pattern a tag.
    """
    counts = written(patterns.groupBy("pattern").agg(F.count("*").alias("freq"), F.min("ordinal").alias("first")), "patterns")
    counts = counts.withColumn("head", F.substring_index("pattern", " ", 1))
    often = counts.filter("freq >= 2").select(F.col("pattern").alias("prefix"), "freq")
    firsts = counts.groupBy("head").agg(F.min("first").alias("first"))
    leads = counts.join(F.broadcast(firsts), ["head", "first"]).groupBy("head").agg(F.min("pattern").alias("lead"))
    single = counts.filter("freq = 1").join(F.broadcast(leads), "head")
    terms = lambda c: F.split(c, F.lit(" "))
    single = single.select(w.common_prefix(w.generalise(terms("pattern")), terms("lead")).alias("p"))
    single = single.filter(F.exists("p", lambda t: t.rlike(r"^[\p{L}\p{N}]+$"))).select(F.array_join("p", " ").alias("prefix"), F.lit(1).cast("long").alias("freq"))
    return often.unionByName(single).groupBy("prefix").agg(F.sum("freq").alias("freq"))


# --- training input, splits

def clean_training(rows: DataFrame) -> DataFrame:
    """Rows of (split, grammar_pattern) that have both, not blank and of equal number."""
    rows = rows.na.drop(subset=["split", "grammar_pattern"]).filter(F.trim("split") != "")
    rows = rows.withColumns({"words": F.split(F.trim("split"), r"\s+"), "tags": F.split(F.trim("grammar_pattern"), r"\s+")})
    return rows.filter(F.size("words") == F.size("tags"))


def has_rare_tag(tags: Column, rare: list[str] = lx.RARE_TAGS) -> Column:
    """Whether an array of tags has one of the rare ones; not for null."""
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, rare))), F.lit(False))


def upsample(rows: DataFrame, rare: Column, times: int = 3) -> DataFrame:
    """Rows with copy from 1: ``times`` copies of rare ones, one of the others. To keep copies in one fold, see ``folds(group=...)``."""
    return rows.withColumn("copy", F.explode(F.when(rare, F.sequence(F.lit(1), F.lit(times))).otherwise(F.array(F.lit(1)))))


def labelled(rows: DataFrame, label: str = "label", ignore: int = -100) -> DataFrame:
    """Rows whose label is not the ignored one; null labels go as well."""
    return rows.filter(F.col(label) != ignore)


def or_invalid(text: Column, mark: str = "Invalid") -> Column:
    """The text, or a mark where it is null or blank."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", mark).otherwise(text)


def with_defaults(rows: DataFrame, names: list[str], value: str = "") -> DataFrame:
    """``rows`` with the named text columns, ``value`` where a column lacks or is null."""
    return rows.withColumns({n: F.coalesce(F.col(n), F.lit(value)) if n in rows.columns else F.lit(value) for n in names})


def stamped(rows: DataFrame, name: str = "tag_time") -> DataFrame:
    """``rows`` with the time of the query and its clock reading."""
    return rows.withColumns({name: F.current_timestamp(), f"{name}_clock": F.date_format(F.current_timestamp(), "HH:mm:ss")})


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(seed)))


def ranked(rows: DataFrame, key: str, seed: int, label: str | None = None, bin_rows: int = 16_384) -> DataFrame:
    """``rows`` with _rank, from 1 by hash of the key within the label, and _total, the label's rows.

    The hash's leading bits deal a label of any size into bins of about ``bin_rows``; only the bins' counts
    are summed up in one task, and ranks are made within bins. Rows that repeat a key are in any order.
    """
    bins = max(1, min(1 << 16, -(-rows.count() // bin_rows)))
    rows = rows.withColumn("_order", hash_order(F.col(key), seed)).withColumn("_label", F.col(label).cast("string") if label else F.lit(""))
    rows = rows.withColumn("_bin", (F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * bins / F.lit(1 << 32)).cast("int"))
    rows = rows.withColumn("_label", F.coalesce(F.concat(F.lit("="), "_label"), F.lit("")))
    counts = rows.groupBy("_label", "_bin").agg(F.count("*").alias("_n"))
    over = Window.partitionBy("_label")
    counts = counts.select("_label", "_bin", (F.sum("_n").over(over.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(over).alias("_total"))
    inner = F.row_number().over(Window.partitionBy("_label", "_bin").orderBy("_order", key))
    out = rows.withColumn("_inner", inner).join(counts, ["_label", "_bin"])
    return out.withColumn("_rank", F.col("_before") + F.col("_inner")).drop("_order", "_bin", "_label", "_before", "_inner")


def stratified_split(rows: DataFrame, label: str, key: str, share: float, seed: int) -> DataFrame:
    """``rows`` with is_test: the first ceil(share * n) of each label in hash order."""
    out = ranked(rows, key, seed, label)
    return out.withColumn("is_test", F.col("_rank") <= F.ceil(F.lit(share) * F.col("_total"))).drop("_rank", "_total")


def folds(rows: DataFrame, key: str, k: int, seed: int, label: str | None = None, group: str | None = None) -> DataFrame:
    """``rows`` with fold, 0 to k - 1, dealt out in turn in hash order: of all rows, or of each label.

    With ``group``, groups are dealt out instead of rows, so that none (such as the copies of an upsampled
    row) is on both sides of a fold.
    """
    if group is not None:
        dealt = folds(rows.select(group).distinct(), group, k, seed)
        return rows.join(dealt, group)
    return ranked(rows, key, seed, label).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_total")


# --- metrics

def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("cnt"))


def confusion_pivot(matrix: DataFrame, labels: list) -> DataFrame:
    return matrix.groupBy("actual").pivot("predicted", labels).agg(F.sum("cnt")).na.fill(0)


def _over(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(F.try_divide(a, b)).cast("double")


def per_class(matrix: DataFrame, by: str | None = None) -> DataFrame:
    """From (actual, predicted, cnt): tp, fp, fn, tn, precision, recall, f1, balanced_accuracy and weighted_accuracy (one against the rest), mcc, support.

    With ``by``, a column that tells many matrices apart, each of them has its own rows.
    """
    own = [by] if by else []
    rows = matrix.groupBy(*own, F.col("actual").alias("label")).agg(F.sum("cnt").alias("r"), F.lit(0).cast("long").alias("c"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("cnt")).otherwise(0)).alias("tp"))
    cols = matrix.groupBy(*own, F.col("predicted").alias("label")).agg(F.lit(0).cast("long").alias("r"), F.sum("cnt").alias("c"), F.lit(0).cast("long").alias("tp"))
    m = rows.unionByName(cols).groupBy(*own, "label").agg(*[F.sum(x).alias(x) for x in ("r", "c", "tp")])
    m = m.withColumn("n", F.sum("r").over(Window.partitionBy(by)) if by else matrix.agg(F.sum("cnt")).scalar())
    m = m.select(*own, "label", "tp", (F.col("c") - F.col("tp")).alias("fp"), (F.col("r") - F.col("tp")).alias("fn"), (F.col("n") - F.col("r") - F.col("c") + F.col("tp")).alias("tn"), F.col("r").alias("support"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    p, r = _over(tp, tp + fp), _over(tp, tp + fn)
    root = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return m.withColumns({"precision": p, "recall": r, "f1": _over(2 * p * r, p + r), "balanced_accuracy": (r + _over(tn, tn + fp)) / 2, "weighted_accuracy": _over(tp + tn, tp + fp + fn + tn), "mcc": _over(tp.cast("double") * tn - fp.cast("double") * fn, root)})


def overall(matrix: DataFrame, by: str | None = None) -> DataFrame:
    """One row (one of each ``by``): accuracy, macro and weighted averages, macro recall over labels that occur, and the mean one-against-rest balanced accuracy."""
    m = per_class(matrix, by)
    n = F.sum("support")
    weigh = lambda c: (F.sum(F.col(c) * F.col("support")) / n).alias(f"weighted_{c}")
    return m.groupBy(*([by] if by else [])).agg((F.sum("tp") / n).alias("accuracy"), *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[weigh(c) for c in ("precision", "recall", "f1")], F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("balanced_accuracy").alias("one_vs_rest_balanced_accuracy"))


def multiclass_mcc(matrix: DataFrame) -> DataFrame:
    m = per_class(matrix).select("tp", "support", (F.col("tp") + F.col("fp")).alias("p"))
    m = m.agg(F.sum("tp").alias("c"), F.sum("support").alias("s"), F.sum(F.col("p") * F.col("support")).alias("pt"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("support") * F.col("support")).alias("tt"))
    s = F.col("s").cast("double")
    return m.select(_over(F.col("c") * s - F.col("pt"), F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))).alias("mcc"))


def all_right(rows: DataFrame, by: str, ok: Column) -> DataFrame:
    """Token and group accuracy: a group is right when all its rows are."""
    each = rows.groupBy(by).agg(F.bool_and(ok).alias("right"), F.sum(ok.cast("int")).alias("hits"), F.count("*").alias("n"))
    return each.agg((F.sum("hits") / F.sum("n")).alias("token_accuracy"), F.avg(F.col("right").cast("double")).alias("identifier_accuracy"), F.sum("n").alias("n_tokens"))


# --- encounters

def encounters(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(ts).alias("first_encounter"), F.max(ts).alias("last_encounter"), F.count("*").alias("cnt"))


def merge_encounters(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new).groupBy(*keys).agg(F.min("first_encounter").alias("first_encounter"), F.max("last_encounter").alias("last_encounter"), F.sum("cnt").alias("cnt"))


def cache_split(requests: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(requests in the cache, requests to tag)."""
    known = cache.select(*keys).distinct()
    return requests.join(known, keys, "left_semi"), requests.join(known, keys, "left_anti")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
