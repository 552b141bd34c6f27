"""Sub-word pieces of words: longest match first over a given vocabulary, by an automaton that reads each byte once.

A node of the automaton is what has been read since the last piece was given out. Where no longer piece can come of
it, its pops are the pieces that the longest match finds in it, and its failure link is the node of what they leave.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pieces of a vocabulary at most. What is sent to tasks is bounded by it.
MOST = 300_000
IDS = "pieces array<int>, of array<int>"


class Automaton:
    """Over pieces that begin a word and pieces inside of one (the same, if ``inners`` is None), each with its id."""

    def __init__(self, starts: dict[bytes, int], inners: dict[bytes, int] | None = None):
        self.step: dict[int, int] = {}  # node * 256 + byte: next node
        self.inner = 0 if inners is None else 1
        value = [-1] * (self.inner + 1)
        level: list[tuple[int, int, int]] = []  # nodes of one depth: node, parent, byte
        for root, keys in ((0, starts), (1, inners or {})):
            for piece, number in keys.items():
                node = root
                for byte in piece:
                    at = node * 256 + byte
                    if at not in self.step:
                        self.step[at] = len(value)
                        value.append(-1)
                    node = self.step[at]
                if node > self.inner:
                    value[node] = number
        self.fail = [-1] * len(value)
        self.pops: list[tuple[int, ...]] = [()] * len(value)
        below: dict[int, list[tuple[int, int, int]]] = {}
        for at, node in self.step.items():
            below.setdefault(at >> 8, []).append((node, at >> 8, at & 255))
        level = [x for root in range(self.inner + 1) for x in below.get(root, [])]
        while level:
            for node, parent, byte in level:
                if value[node] >= 0:
                    self.fail[node], self.pops[node] = self.inner, (value[node],)
                    continue
                at, out = self.fail[parent], self.pops[parent]
                while at >= 0 and at * 256 + byte not in self.step:
                    at, out = self.fail[at], out + self.pops[at]
                if at >= 0:
                    self.fail[node], self.pops[node] = self.step[at * 256 + byte], out
            level = [x for node, _, _ in level for x in below.get(node, [])]

    def match(self, text: bytes) -> list[int] | None:
        """Ids of the longest piece that begins the text, of the longest that begins the rest, and so on; None if one lacks."""
        step, fail, pops, node, out = self.step, self.fail, self.pops, 0, []
        for byte in text:
            while (at := step.get(node * 256 + byte)) is None:
                if fail[node] < 0:
                    return None
                out += pops[node]
                node = fail[node]
            node = at
        while node > self.inner:
            if fail[node] < 0:
                return None
            out += pops[node]
            node = fail[node]
        return out


@dataclass
class Pieces:
    """A vocabulary. ``lead`` goes before each word; ``special`` tokens are pieces of their own; ``unknown`` is the id of a word that pieces don't cover."""

    automaton: Automaton
    lead: bytes = b""
    special: dict[str, int] = field(default_factory=dict)
    unknown: int | None = None

    def encode(self, token: str | None) -> list[int]:
        """Ids of a token; none of null and of empty text."""
        if not token:
            return []
        if token in self.special:
            return [self.special[token]]
        found = self.automaton.match(self.lead + token.encode())
        if found is None:
            if self.unknown is None:
                raise ValueError(f"no pieces for {token!r}, and no id for unknown words")
            return [self.unknown]
        return found

    def sequence(self, tokens: Column, begin: str | None = None, end: str | None = None, longest: int | None = None) -> Column:
        """(pieces, of) of an array of tokens: ids, and the number from 0 of the token that each piece is of.

        ``begin`` and ``end`` are special tokens that are put around, of no token (null). With ``longest`` a sequence
        is cut so that it has no more pieces than that. Null and empty tokens have no pieces; a null array is empty.
        A batch's distinct tokens are encoded once, in place, so that nothing is shuffled.
        """
        sent = SparkSession.active().sparkContext.broadcast(self)

        @F.pandas_udf(IDS)
        def run(batch: pd.Series) -> pd.DataFrame:
            own, known = sent.value, {}
            first, last = ([(own.special[x], None)] if x is not None else [] for x in (begin, end))
            pieces, of = [], []
            for row in batch:
                pairs = []
                for i, token in enumerate(row if row is not None else ()):
                    if token not in known:
                        known[token] = own.encode(token)
                    pairs += [(x, i) for x in known[token]]
                if longest is not None:
                    pairs = pairs[: max(0, longest - len(first) - len(last))]
                pairs = first + pairs + last
                pieces.append([x for x, _ in pairs])
                of.append([i for _, i in pairs])
            return pd.DataFrame({"pieces": pd.Series(pieces, dtype=object), "of": pd.Series(of, dtype=object)})

        return run(tokens)


def read_byte_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(piece binary, id int) from lines of a piece in base 64 and its number. Empty lines are left out."""
    parts = F.split("value", " ")
    return spark.read.text(path).filter("trim(value) <> ''").select(F.unbase64(parts[0]).alias("piece"), parts[1].cast("int").alias("id"))


def pieces_of(vocabulary: DataFrame, lead: bytes = b"", inner: bytes | None = None, special: Iterable[str] = (), unknown: int | None = None, most: int = MOST) -> Pieces:
    """From (piece binary, id), an error beyond ``most`` rows. Special tokens get the numbers after the highest id.

    With ``inner``, such as ``##``, pieces that begin with it are those inside of words and all others begin words;
    without it every piece may stand anywhere. Null and empty pieces are left out; of a piece's ids the least counts.
    """
    rows = vocabulary.filter("length(piece) > 0 AND id IS NOT NULL").groupBy("piece").agg(F.min("id").alias("id")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary of more than {most} pieces")
    keys = {bytes(r["piece"]): r["id"] for r in rows}
    free = max([*keys.values(), -1 if unknown is None else unknown], default=-1) + 1
    named = {name: free + i for i, name in enumerate(dict.fromkeys(special))}
    if inner is None:
        return Pieces(Automaton(keys), lead, named, unknown)
    inside = {p[len(inner) :]: i for p, i in keys.items() if p.startswith(inner) and p != inner}
    return Pieces(Automaton({p: i for p, i in keys.items() if not p.startswith(inner) or p == inner}, inside), lead, named, unknown)


def encoded(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, pieces) of each distinct word of a frame of ``word``; nulls are left out."""
    sent = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        for b in batches:
            found = [sent.value.encode(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["word", "pieces"])

    return words.select("word").filter("word IS NOT NULL").distinct().mapInArrow(run, "word string, pieces array<int>")


def piece_features(pieces: Column, slots: int) -> Column:
    """Features of each piece as slots: itself, the two before and after it, and the first piece, which names the context."""
    slot = lambda name, *x: F.pmod(F.xxhash64(F.lit(name), *x), F.lit(slots)).cast("int")
    near = lambda i: F.coalesce(F.get(pieces, i), F.lit(-1))
    each = lambda p, i: F.array_distinct(F.array(
        slot("bias"), slot("own", p), slot("before", near(i - 1)), slot("before2", near(i - 2)), slot("after", near(i + 1)), slot("after2", near(i + 2)),
        slot("around", near(i - 1), near(i + 1)), slot("first", near(F.lit(0)), p),
    ))
    return F.transform(pieces, each)


def first_of_tokens(of: Column, values: Column) -> Column:
    """The value at the first piece of each token, in order; tokens without a piece have none."""
    each = F.zip_with(of, values, lambda o, v: F.struct(o.alias("o"), v.alias("v")))
    firsts = F.filter(each, lambda x, i: x["o"].isNotNull() & ((i == 0) | ~x["o"].eqNullSafe(F.get(of, i - 1))))
    return F.transform(firsts, lambda x: x["v"])
