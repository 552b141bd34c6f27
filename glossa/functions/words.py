"""Column functions on identifiers and words."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .lexicon import context_token


def split_identifier(name: Column) -> Column:
    """Words of an identifier: parted at other characters, at case changes, before the last capital of a row of capitals, and before digits."""
    x = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}]+", " ")
    for pattern in (r"([\p{Ll}0-9])(\p{Lu})", r"(\p{Lu}+)(\p{Lu}\p{Ll})", r"(\p{L})([0-9])"):
        x = F.regexp_replace(x, pattern, "$1 $2")
    return F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")


#: The expression of ``split_identifier`` in SQL.
SPLIT_SQL = r"""filter(split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(identifier, ''), r'[^\p{L}\p{N}]+', ' '),
  r'([\p{Ll}0-9])(\p{Lu})', '$1 $2'), r'(\p{Lu}+)(\p{Lu}\p{Ll})', '$1 $2'), r'(\p{L})([0-9])', '$1 $2')), r'\s+'), w -> w <> '')"""


def register_split(spark: SparkSession) -> None:
    """``split_identifier_rows(identifier)`` as a table function of SQL: (word, position), the words that ``split_identifier`` gives."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION split_identifier_rows(identifier STRING) RETURNS TABLE (word STRING, position INT) RETURN SELECT word, position FROM (SELECT posexplode({SPLIT_SQL}) AS (position, word))")


def split_by_frequency(costs: dict[str, float], unknown: float = 12.0) -> Callable:
    """A pandas UDF that parts a same-case word where the words' costs (negative log frequencies) are least."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(s: pd.Series) -> pd.Series:
        longest = max(map(len, costs), default=1)

        def one(word):
            if word is None:
                return None
            best = [(0.0, [])]
            for i in range(1, len(word) + 1):
                options = [(best[j][0] + costs.get(word[j:i].lower(), unknown * (i - j)), best[j][1] + [word[j:i]]) for j in range(max(0, i - longest), i)]
                best.append(min(options, key=lambda o: o[0]))
            return best[-1][1] if best[-1][0] < unknown * len(word) else [word]

        return s.map(one)

    return run


def consonant_vowel_ratio(word: Column) -> Column:
    low = F.lower(word)
    vowels = F.length(low) - F.length(F.translate(low, "aeiou", ""))
    # most words are letters alone, of which only the others are looked at one by one
    letters = F.when(low.rlike(r"[^\p{L}]"), F.length(F.regexp_replace(low, r"[^\p{L}]", ""))).otherwise(F.length(low))
    consonants = letters - vowels
    return F.when(vowels > 0, consonants / vowels).otherwise(0.0)


def ratio_bucket(words: Column) -> Column:
    """Bucket of the mean ratio over words of letters alone; a word without vowels counts as very high."""
    letters = F.filter(words, lambda w: w.rlike(r"^\p{L}+$"))
    others = lambda w: F.length(F.translate(F.lower(w), "aeiou", ""))
    each = F.transform(letters, lambda w: others(w) / (F.length(F.lower(w)) - others(w) + F.lit(1e-5)))
    mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(letters)
    return F.when(F.size(letters) == 0, "@cvr_none").otherwise(F.when(mean < 1.5, "@cvr_low").when(mean < 3.0, "@cvr_mid").otherwise("@cvr_high"))


def hungarian_prefix(first: Column) -> Column:
    found = F.regexp_extract(F.coalesce(first, F.lit("")), r"^([a-zA-Z]{1,3})[A-Z_]", 1)
    return F.when(found == "", "@hung_none").otherwise(F.concat(F.lit("@hung_"), F.lower(found)))


def digit_token(words: Column) -> Column:
    return F.when(F.exists(words, lambda w: w.rlike(r"\p{Nd}")), "@has_digit").otherwise("@no_digit")


def is_digits(word: Column) -> Column:
    return word.rlike(r"^\p{Nd}+$").cast("int")


def has_digits(text: Column) -> Column:
    return text.rlike(r"\p{Nd}").cast("int")


def is_plural(word: Column) -> Column:
    return F.lower(word).endswith("s") & (F.length(word) > 1)


def last_letter(word: Column) -> Column:
    return F.ascii(F.lower(F.substring(word, -1, 1)))


def second_last_letter(word: Column) -> Column:
    return F.ascii(F.lower(F.substr(word, F.greatest(F.length(word) - 1, F.lit(1)), F.lit(1))))


def normalize_type(name: Column) -> Column:
    return F.concat(F.lit("@"), F.replace(F.replace(F.lower(F.trim(name)), F.lit("*"), F.lit("_ptr")), F.lit(" "), F.lit("_")))


def normalize_language(name: Column) -> Column:
    return F.concat(F.lit("@lang_"), F.replace(F.replace(F.lower(F.trim(name)), F.lit("++"), F.lit("pp")), F.lit("#"), F.lit("sharp")))


def file_extension(path: Column, language: Column) -> Column:
    base = F.regexp_extract(path, r"[^/]+$", 0)
    return F.when(base.contains(".xml_identifiers"), F.replace(base, F.lit(".xml_identifiers"), language)).otherwise(base)


def system_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.split(path, "/"), lambda x: x.endswith(".git")), F.lit(1)), F.lit("unknown"))


def url_name(words: Column, context: Column | None = None) -> Column:
    """Words joined by _ in lower case; with a context number, functions get ()."""
    name = F.lower(F.array_join(words, "_"))
    return name if context is None else F.when(context == 4, F.concat(name, F.lit("()"))).otherwise(name)


@F.pandas_udf(StringType())
def similarity_bucket(a: pd.Series, b: pd.Series) -> pd.Series:
    """Bucket of the sequence-matching ratio of two names; blanks have none. Equal pairs of a batch are compared once."""

    def one(x, y):
        if not x.strip() or not y.strip():
            return "@sim_none"
        r = difflib.SequenceMatcher(None, x, y).ratio()
        return "@sim_high" if r > 0.9 else "@sim_mid" if r > 0.6 else "@sim_low" if r > 0.3 else "@sim_none"

    pairs = pd.MultiIndex.from_arrays([a.fillna("").str.lower(), b.fillna("").str.lower()])
    codes, own = pairs.factorize()
    return pd.Series([one(x, y) for x, y in own], dtype=object).take(codes).reset_index(drop=True)


def position_tokens(n: Column) -> Column:
    return F.when(n <= 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("@pos_2"))).otherwise(
        F.concat(F.array(F.lit("@pos_0")), F.array_repeat(F.lit("@pos_1"), (n - 2).cast("int")), F.array(F.lit("@pos_2")))
    )


#: Token features by name, each of (words, context); registering more makes sequences longer.
TOKEN_FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "context": lambda words, context: context_token(context),
    "hungarian": lambda words, context: hungarian_prefix(F.try_element_at(words, F.lit(1))),
    "cvr": lambda words, context: ratio_bucket(words),
    "digit": lambda words, context: digit_token(words),
}


def register_token_feature(name: str, fn: Callable[[Column, Column], Column]) -> None:
    TOKEN_FEATURES[name] = fn


def feature_tokens(words: Column, context: Column) -> Column:
    return F.array(*[f(words, context) for f in TOKEN_FEATURES.values()])


def model_tokens(words: Column, context: Column) -> Column:
    """Feature tokens, then a position token and the word in turn."""
    pairs = F.zip_with(position_tokens(F.size(words)), words, lambda p, w: F.array(p, w))
    return F.concat(feature_tokens(words, context), F.flatten(pairs))


def model_labels(tags: Column, labels: list[str]) -> Column:
    """-100 for feature and position tokens, the tag's number for words; an unknown tag raises."""
    ids = F.create_map(*[F.lit(x) for i, t in enumerate(labels) for x in (t, i)])
    number = lambda t: F.coalesce(F.try_element_at(ids, t), F.raise_error(F.concat(F.lit("unknown tag "), t)).cast("int"))
    return F.concat(F.array_repeat(F.lit(-100), len(TOKEN_FEATURES)), F.flatten(F.transform(tags, lambda t: F.array(F.lit(-100), number(t)))))


def piece_labels(word_of_piece: Column, labels: Column) -> Column:
    """Each sub-token's label is its word's; -100 for those of no word."""
    return F.transform(word_of_piece, lambda w: F.coalesce(F.try_element_at(labels, w + 1), F.lit(-100)))


def decode_labels(ids: Column, labels: list[str]) -> Column:
    return F.transform(ids, lambda i: F.try_element_at(F.array(*map(F.lit, labels)), (i + 1).cast("int")))


def parse_pairs(record: Column) -> Column:
    """word|POS items of a record; without POS it is Unknown, items of more parts are left out."""
    parts = F.filter(F.transform(F.split(F.trim(F.regexp_replace(record, '^"+|"+$', "")), ","), lambda x: F.split(x, r"\|")), lambda p: F.size(p) <= 2)
    return F.transform(parts, lambda p: F.struct(F.trim(p[0]).alias("word"), F.coalesce(F.trim(F.try_element_at(p, F.lit(2))), F.lit("Unknown")).alias("pos")))


def tag_of(word: Column, words: Column, tags: Column) -> Column:
    """Tag of the first word equal to ``word`` but for case, else NOT_FOUND."""
    hit = F.filter(F.zip_with(words, tags, lambda w, t: F.struct(w.alias("w"), t.alias("t"))), lambda s: F.lower(s["w"]) == F.lower(word))
    return F.coalesce(F.try_element_at(hit, F.lit(1))["t"], F.lit("NOT_FOUND"))


def generalise(terms: Column) -> Column:
    return F.when(F.size(terms) > 1, F.slice(terms, 1, F.size(terms) - 1)).otherwise(terms)


def common_prefix(a: Column, b: Column) -> Column:
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs == 0, a).otherwise(F.slice(a, 1, (differs - 1).cast("int")))


def argmax(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
