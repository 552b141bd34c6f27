"""Splitting words of one case, such as ``getusername``, into the pieces that a table of word counts makes most likely.

A dictionary of counted words becomes a trie in two arrays, small enough to be sent to every task. Each distinct
word is segmented once, at the least cost, and the pieces are joined back to where the word occurs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a dictionary, by default: the most frequent ones. What is sent to tasks is bounded by it.
MOST = 50_000
UNKNOWN = 3.0  # a letter outside of all pieces costs that much more than a word that was counted once


class Trie:
    """A double array over the bytes of sorted distinct keys: node s has a child by byte c at base[s] + c + 1 if check there is s.

    The number of a key that ends at a node is its value there, else -1.
    """

    def __init__(self, keys: list[bytes]):
        self.base, self.check, self.value = [0], [0], [-1]
        used, free, todo = {0}, 1, [(0, 0, 0, len(keys))]  # node, depth, first and last key
        while todo:
            node, depth, a, b = todo.pop()
            if a < b and len(keys[a]) == depth:
                self.value[node] = a
                a += 1
            children = []
            while a < b:
                c, start = keys[a][depth], a
                while a < b and keys[a][depth] == c:
                    a += 1
                children.append((c + 1, start, a))
            if not children:
                continue
            while free in used:
                free += 1
            base = max(1, free - children[0][0])
            while any(base + c in used for c, _, _ in children):
                base += 1
            self.base[node] = base
            for c, start, end in children:
                at = base + c
                for x, empty in ((self.base, 0), (self.check, -1), (self.value, -1)):
                    x.extend([empty] * (at + 1 - len(x)))
                used.add(at)
                self.check[at] = node
                todo.append((at, depth + 1, start, end))

    def ends(self, text: bytes, start: int) -> list[tuple[int, int]]:
        """(end, number) of every key that begins at a place of the text, shortest first."""
        base, check, value, node, out = self.base, self.check, self.value, 0, []
        for i in range(start, len(text)):
            at = base[node] + text[i] + 1
            if at >= len(check) or check[at] != node or not at:
                break
            node = at
            if value[node] >= 0:
                out.append((i + 1, value[node]))
        return out


@dataclass
class Dictionary:
    """Words and what each costs: the logarithm of all counts over its own. ``letter`` is the cost of a letter outside of all words."""

    trie: Trie
    costs: list[float]
    letter: float

    @classmethod
    def of(cls, counts: dict[str, float], unknown: float = UNKNOWN) -> Dictionary:
        words = sorted(w.encode() for w in counts)
        total = math.log(sum(counts.values()) or 1.0)
        return cls(Trie(words), [total - math.log(counts[w.decode()]) for w in words], total + unknown)

    def segment(self, word: str) -> tuple[list[str], float]:
        """(pieces, cost) of least cost; of equal cost the fewest pieces, then the longest first ones. Unknown letters are pieces of their own."""
        text = word.encode()
        n = len(text)
        best: list = [None] * n + [(0.0, 0, n)]  # cost, pieces and end of the first piece of what begins here
        for i in range(n - 1, -1, -1):
            if text[i] & 0xC0 == 0x80:  # inside of a letter
                continue
            one = i + 1
            while one < n and text[one] & 0xC0 == 0x80:
                one += 1
            found = [(self.letter + best[one][0], 1 + best[one][1], -one)]
            found += [(self.costs[k] + best[end][0], 1 + best[end][1], -end) for end, k in self.trie.ends(text, i)]
            cost, pieces, end = min(found)
            best[i] = (cost, pieces, -end)
        out, at = [], 0
        while at < n:
            out.append(text[at : best[at][2]].decode())
            at = best[at][2]
        return out, best[0][0]


def dictionary_of(counts: DataFrame, most: int = MOST, shortest: int = 2, unknown: float = UNKNOWN) -> Dictionary:
    """From (word, cnt) the ``most`` frequent words of ``shortest`` letters or more, in lower case; of equal counts the first by code point.

    Nulls, words without a count above 0 and shorter ones are left out.
    """
    words = counts.filter((F.char_length("word") >= shortest) & (F.col("cnt") > 0)).groupBy(F.lower("word").alias("word")).agg(F.sum("cnt").cast("double").alias("cnt"))
    return Dictionary.of({r["word"]: r["cnt"] for r in words.orderBy(F.desc("cnt"), "word").limit(most).collect()}, unknown)


def segmented(words: DataFrame, dictionary: Dictionary) -> DataFrame:
    """(word, pieces, cost) of each distinct word of a frame of ``word``, in lower case; an empty word has no pieces, nulls are left out."""
    sent = words.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        for b in batches:
            own = b.column(0).to_pylist()
            found = [sent.value.segment(w) for w in own]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in found], pa.list_(pa.string())), pa.array([c for _, c in found], pa.float64())], names=["word", "pieces", "cost"])

    return words.select(F.lower("word").alias("word")).filter("word IS NOT NULL").distinct().mapInArrow(run, "word string, pieces array<string>, cost double")


def split_same_case(rows: DataFrame, dictionary: Dictionary, key: str = "id", words: str = "words", shortest: int = 4) -> DataFrame:
    """``rows`` (key without repeats, words array<string>) with each word in its pieces, spelled as it was.

    Words of one case alone are split, and only from ``shortest`` letters on; pieces that are single letters are no
    evidence, so that a word with one is left whole.
    """
    each = rows.select(key, F.posexplode(words).alias("_at", "_word"))
    one_case = (F.col("_word").rlike(r"^(\p{Ll}+|\p{Lu}+|\p{Lu}\p{Ll}+)$")) & (F.char_length("_word") >= shortest)
    found = segmented(each.filter(one_case).select(F.col("_word").alias("word")), dictionary)
    found = found.filter(~F.exists("pieces", lambda p: F.char_length(p) < 2)).select(F.col("word").alias("_low"), F.transform("pieces", lambda p: F.char_length(p)).alias("_sizes"))
    each = each.withColumn("_low", F.when(one_case, F.lower("_word"))).join(found, "_low", "left")
    whole = F.coalesce("_sizes", F.array(F.char_length("_word")))
    ends = lambda i: F.aggregate(F.slice(whole, 1, i), F.lit(0), lambda a, x: a + x)
    pieces = F.transform(whole, lambda size, i: F.substr("_word", ends(i) + 1, size))
    pieces = F.when(F.char_length(F.lower("_word")) == F.char_length("_word"), pieces).otherwise(F.array("_word"))
    each = each.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", pieces.alias("p")))), lambda s: s["p"])).alias("_split"))
    out = rows.join(each, key, "left").withColumn(words, F.coalesce("_split", F.col(words)))
    return out.drop("_split")
