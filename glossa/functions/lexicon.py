"""Tags, contexts, feature lists, and small word lists written from general knowledge of English grammar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
TAGS = ["CJ", "D", "DT", "N", "NM", "NPL", "P", "PRE", "V", "VM"]
RARE_TAGS = ["CJ", "VM", "PRE", "V"]

# Fixed values of the annotation scheme.
CONTEXT_NUMBERS = {"ATTRIBUTE": 1, "CLASS": 2, "DECLARATION": 3, "FUNCTION": 4, "PARAMETER": 5}
CONTEXT_TOKENS = {"FUNCTION": "@func", "PARAMETER": "@param", "ATTRIBUTE": "@attr", "DECLARATION": "@decl", "CLASS": "@class"}
PENN_COARSE = {
    "NN": "NOUN", "NNP": "NOUN", "NNS": "NOUN_PL", "NNPS": "NOUN_PL",
    "VB": "VERB", "VBD": "VERB", "VBG": "VERB", "VBN": "VERB", "VBP": "VERB", "VBZ": "VERB", "MD": "VERB",
    "JJ": "ADJ", "JJR": "ADJ", "JJS": "ADJ", "RB": "ADV", "RBR": "ADV", "RBS": "ADV", "WRB": "ADV",
    "DT": "DET", "WDT": "DET", "PDT": "DET", "PRP": "DET", "PRP$": "DET", "WP": "DET", "WP$": "DET", "EX": "DET",
    "IN": "ADP", "TO": "ADP", "CC": "CONJ", "CD": "NUM", "LS": "NUM",
    "SYM": "NOUN", "UH": "NOUN", "FW": "NOUN", "POS": "NOUN", "RP": "NOUN", "X": "NOUN",
    "START": "START", "END": "END", ".": ".",
}
COARSE_NUMBERS = {"VERB": 0, "NOUN": 1, "ADJ": 2, "ADV": 3, "ADP": 4, "CONJ": 5, "DET": 6, "NUM": 7, "NOUN_PL": 8, ".": 9, "START": 10, "END": 11}
PENN_TAGS = {
    "CC": "CJ", "CD": "D", "DT": "DT", "IN": "P", "TO": "P",
    "JJ": "NM", "JJR": "NM", "JJS": "NM", "VBD": "NM", "VBG": "NM", "VBN": "NM",
    "FW": "N", "LS": "N", "NN": "N", "NNP": "N", "SYM": "N", "NNS": "NPL", "NNPS": "NPL",
    "MD": "V", "VB": "V", "VBP": "V", "VBZ": "V", "PRP": "PR", "PRPS": "PR", "RB": "VM", "RBR": "VM", "RP": "VM",
}

# The features a model learns from, those that are carried along, and those that go before it learns.
STABLE_FEATURES = ["WORD", "SPLIT_IDENTIFIER", "CONTEXT_NUMBER"]
MODEL_FEATURES = [
    "ENGLISHPRE_SCORE", "PREPOSITION", "DETERMINER", "PREP_SCORE", "NORMALIZED_POSITION", "DET_SCORE", "CONSONANT_VOWEL_RATIO", "PREV_POS", "NEXT_POS", "NLTK_POS",
    "MORPHOLOGICAL_PLURAL", "POSITION", "MAXPOSITION", "POSITION_RATIO", "ENGLISH_VERB_SCORE", "CONJ_SCORE", "ENGLISH_NOUN_SCORE",
]
DROPPED_FEATURES = ["SPLIT_IDENTIFIER", "WORD", "MAXPOSITION", "POSITION"]

# Our own words: closed classes and a few of the open ones. Larger lists come as tables.
CONJUNCTIONS = ["and", "or", "nor", "but", "so", "yet", "for", "because", "although", "unless", "while", "if", "than", "whether"]
DETERMINERS = ["a", "an", "the", "this", "that", "these", "those", "each", "every", "all", "any", "some", "no", "both", "either", "neither", "my", "your", "his", "her", "its", "our", "their"]
PREPOSITIONS = ["of", "in", "on", "at", "by", "to", "from", "with", "without", "for", "as", "into", "onto", "over", "under", "between", "through", "before", "after", "since", "until", "about", "against", "per", "via"]
VERBS = ["get", "set", "is", "has", "be", "do", "make", "run", "add", "remove", "create", "delete", "update", "find", "read", "write", "open", "close", "start", "stop", "print", "parse", "load", "save", "send", "test"]
NOUNS = ["name", "value", "list", "map", "file", "key", "type", "data", "index", "size", "count", "string", "number", "object", "user", "time", "path", "node", "test", "set"]
HUNGARIAN = ["b", "c", "dw", "f", "fn", "g", "h", "i", "l", "lp", "m", "n", "p", "s", "sz", "u", "w"]
LEXICON = {"CONJUNCTION": CONJUNCTIONS, "DETERMINER": DETERMINERS, "PREPOSITION": PREPOSITIONS, "VERB": VERBS, "NOUN": NOUNS, "HUNGARIAN": HUNGARIAN}


def lookup(table: dict, key: Column, default=None) -> Column:
    """The table's value of a key, else the default."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), default if isinstance(default, Column) else F.lit(default))


def lexicon_table(spark: SparkSession, lexicon: dict[str, list[str]] = LEXICON) -> DataFrame:
    """Rows (word, class), for lists of any size: joined, broadcast by their own size."""
    return spark.createDataFrame([(w, c) for c, words in lexicon.items() for w in words], "word string, class string")


def closed_set(lexicon: dict[str, list[str]] = LEXICON) -> list[str]:
    return sorted({w for c in ("CONJUNCTION", "DETERMINER", "PREPOSITION") for w in lexicon[c]})


def context_token(context: Column) -> Column:
    return lookup(CONTEXT_TOKENS, F.upper(F.trim(F.coalesce(context, F.lit("")))), "@unknown")


def context_number(context: Column, default: int | None = None) -> Column:
    return lookup(CONTEXT_NUMBERS, F.coalesce(context, F.lit("")), F.lit(default).cast("int"))


def context_name(number: Column) -> Column:
    return lookup({v: k for k, v in CONTEXT_NUMBERS.items()}, number, "DEFAULT")


def coarse_number(penn: Column) -> Column:
    return lookup(COARSE_NUMBERS, lookup(PENN_COARSE, penn, "NOUN"), 1)


def penn_tag(penn: Column) -> Column:
    return lookup(PENN_TAGS, penn, "UNKNOWN")
