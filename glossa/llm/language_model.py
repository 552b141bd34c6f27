"""Language-model scoring by deleted interpolation.

The probability of a word mixes the maximum-likelihood estimates of the bigram, the word and the uniform
distribution. The mixture weights depend on how often the context was seen, by powers of two, and are
learned by expectation-maximisation on held-out counts: those of training documents kept apart while the
estimates are made. The final estimates are of all training documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .hashing import M, Words, chunks, mix
from .packing import ASKED, BLOCK_BYTES, asked, n_parts, pack, pack_sorted, totals, trim, unpack, unpack_counts, unpack_sorted
from .shared import crc_mod, fresh_path, text_bytes, written

END = np.uint64(0x5851F42D4C957F2D)  # the name of the end, which is the context of first words too
BUCKETS = 40
STEPS = 8  # of a power of two, to which probabilities are rounded where weights are learned

#: What a document is for: not learned from, learned from, learned from and kept apart for the weights.
UNSEEN, COUNTED, APART = 0, 1, 2


def _blocks(limit: int, id_type):
    def run(batches):
        words, base, k = Words(), TaskContext.get().partitionId() << 32, 0
        kinds = [("block", pa.int64()), ("ids", pa.list_(id_type)), ("uses", pa.list_(pa.int32())), ("lens", pa.list_(pa.int32())), ("names", pa.binary()), ("codes", pa.binary())]
        ids, uses, lens, names, size = [], [], [], [], 0

        def block():
            every, codes = np.unique(np.concatenate(names), return_inverse=True)
            row = {"block": base + k, "ids": ids, "uses": uses, "lens": lens, "names": pack_sorted(every), "codes": pack(codes.astype(np.uint32))}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema(kinds))

        for keys, texts in chunks(_paired(batches)):
            found, counts = words(texts)
            ends = np.cumsum(counts)
            names.append(np.insert(found, ends, END))
            lens += (counts + 1).tolist()
            ids += [i for i, _ in keys]
            uses += [u for _, u in keys]
            size += sum(map(len, texts)) + len(texts)
            if size >= limit:
                yield block()
                ids, uses, lens, names, size, k = [], [], [], [], 0, k + 1
                trim()
        if ids:
            yield block()
        trim()

    return run


def _paired(batches):
    """Batches of (id, use, text) as (struct of id and use, text)."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            yield _Pair(list(zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)), some.column(2).to_pylist())


class _Pair:
    def __init__(self, keys, texts):
        self.columns, self.num_rows = (keys, texts), len(keys)

    def slice(self, start, n):
        return _Pair(self.columns[0][start : start + n], self.columns[1][start : start + n])

    def column(self, i):
        return _List(self.columns[i])


class _List(list):
    def to_pylist(self):
        return self


class Block:
    """A block's tokens: codes into its sorted distinct names, and its sorted distinct bigrams."""

    def __init__(self, row: dict):
        self.names, self.codes = unpack_sorted(row["names"]), unpack(row["codes"], np.uint32)
        lens = np.array(row["lens"], np.int64)
        self.starts = np.cumsum(lens) - lens
        self.use = np.repeat(np.array(row["uses"], np.int8), lens)
        before = np.roll(self.codes, 1)
        before[self.starts] = np.searchsorted(self.names, END)
        name = mix(self.names[before] * M + self.names[self.codes])
        self.pairs, first, self.pair_of = np.unique(name, return_index=True, return_inverse=True)
        self.context, self.word = before[first], self.codes[first]

    def counts(self, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.bincount(of[self.use == u], minlength=n) for u in (COUNTED, APART))

    def take(self, answers: list[dict], parts: int) -> None:
        """Corpus counts of names and pairs: (of documents counted, of those apart)."""
        rows = sorted(answers, key=lambda r: r["part"])
        for kind, what in enumerate(("name_counts", "pair_counts")):
            own = [r for r in rows if r["part"] // parts == kind]
            setattr(self, what, tuple(np.concatenate([unpack_counts(r[c]) for r in own]) for c in "ab"))


def _ask(parts: int):
    def run(batches):
        kinds = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = Block(row)
                for kind, keys, of in ((0, b.names, b.codes), (1, b.pairs, b.pair_of)):
                    rows = list(asked(row["block"], keys, *b.counts(of, len(keys)), parts, kind * parts))
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                del b
                trim()

    return run


def bucket(context_count: np.ndarray) -> np.ndarray:
    return np.where(context_count > 0, np.minimum(np.log2(np.maximum(context_count, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _cells(parts: int, n_main: int):
    """Of the tokens kept apart: how many there are by bucket and rounded logarithms of both estimates."""

    def run(batches):
        kinds = pa.schema([("bucket", pa.int32()), ("pair", pa.int32()), ("word", pa.int32()), ("n", pa.int64())])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if APART not in row["uses"]:
                    continue
                b = Block(row)
                b.take(row["answers"], parts)
                n = np.bincount(b.pair_of[b.use == APART], minlength=len(b.pairs))
                names, pairs = b.name_counts[0], b.pair_counts[0]
                context = names[b.context]
                with np.errstate(divide="ignore"):
                    p2 = np.where(pairs > 0, np.round(np.log2(pairs / np.maximum(context, 1)) * STEPS), -999)
                    p1 = np.where(names[b.word] > 0, np.round(np.log2(names[b.word] / max(n_main, 1)) * STEPS), -999)
                cell = np.stack([bucket(context), p2.astype(np.int64), p1.astype(np.int64)])[:, n > 0]
                cells, at = np.unique(cell, axis=1, return_inverse=True)
                sums = np.bincount(at.reshape(-1), weights=n[n > 0], minlength=cells.shape[1]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cells), pa.array(sums, pa.int64())], schema=kinds)
                del b
                trim()

    return run


def learn_weights(cells: list[tuple[int, int, int, int]], n_types: int, rounds: int = 60) -> np.ndarray:
    """Weights (uniform, word, bigram) of each bucket by expectation-maximisation; a bucket without tokens takes its lower neighbour's."""
    out = np.tile([0.1, 0.45, 0.45], (BUCKETS, 1))
    out[0] = [0.1, 0.9, 0.0]
    table = np.array(cells, np.float64).reshape(-1, 4)
    for k in range(BUCKETS):
        own = table[table[:, 0] == k]
        if not len(own):
            out[k] = out[k - 1] if k > 1 else out[k]
            continue
        p = np.stack([np.full(len(own), 1 / (n_types + 1)), *(np.where(own[:, c] > -999, 2.0 ** (own[:, c] / STEPS), 0) for c in (2, 1))], axis=1)
        w = out[k].copy()
        for _ in range(rounds):
            share = p * w
            w = (own[:, 3:] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) + 1e-3
            w = w / w.sum() if k else np.array([w[0], w[1], 0.0]) / (w[0] + w[1])
        out[k] = w
    return out


def _score(parts: int, n: int, types: int, weights: np.ndarray, id_type):
    def run(batches):
        names = ["id", "n_tokens", "n_known", "base_score", "score"]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = Block(row)
                b.take(row["answers"], parts)
                seen, pairs = sum(b.name_counts), sum(b.pair_counts)
                base = np.log10((seen + 0.1) / (n + 0.1 * (types + 1)))
                context, word = seen[b.context], seen[b.word]
                w = weights[bucket(context)]
                p = w[:, 0] / (types + 1) + w[:, 1] * word / max(n, 1) + w[:, 2] * pairs / np.maximum(context, 1)
                model = np.log10(p)
                sums = [np.add.reduceat(x, b.starts) for x in ((seen > 0)[b.codes].astype(np.int64), base[b.codes], model[b.pair_of])]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], id_type), pa.array(row["lens"], pa.int64()), *map(pa.array, sums)], names=names)
                del b
                trim()

    return run


@dataclass
class Scores:
    frame: DataFrame
    train_tokens: int
    types: int
    weights: np.ndarray


def score(docs: DataFrame, learn: Column, apart: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Scores:
    """One row per row of ``docs``: id, n_tokens, n_known, base_score, score (log10 probabilities of the text).

    ``learn`` and ``apart`` are conditions on ``id_col``: what is learned from, and what of it is kept apart
    while weights are learned. A token is a run of other than ASCII white space, A-Z lower-cased, or the one
    end of a text; null and empty texts have the end alone. An unseen word has the share of one type more
    than there are. If nothing is learned from, all words are unseen. Rows that repeat an id count as often
    as they occur; null ids are learned from if ``learn`` says so (null: no). Other columns are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    use = F.when(F.coalesce(learn & apart, F.lit(False)), APART).when(F.coalesce(learn, F.lit(False)), COUNTED).otherwise(UNSEEN)
    rows = docs.select(F.col(id_col).alias("id"), use.alias("use"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    id_type, parts = to_arrow_type(kind), n_parts(text_bytes(rows))
    path = fresh_path(spark, "tokens")
    table = path.rpartition("/")[2].replace("-", "_")
    blocks = rows.mapInArrow(_blocks(block_bytes, id_type), f"block long, ids array<{kind.simpleString()}>, uses array<int>, lens array<int>, names binary, codes binary")
    blocks.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("path", path).format("parquet").saveAsTable(table)
    blocks = spark.table(table)
    answers = written(totals(blocks.mapInArrow(_ask(parts), ASKED), 2 * parts), "totals")
    by_kind = {r[0]: r[1:] for r in answers.groupBy((F.col("part") >= parts).alias("k")).agg(F.sum("n_keys"), F.sum("sum_a"), F.sum("sum_b")).collect()}
    types, n_main, n_apart = by_kind.get(False, (0, 0, 0))
    own = answers.select("block", F.struct("part", "a", "b").alias("x")).groupBy("block").agg(F.collect_list("x").alias("answers"))
    met = blocks.join(own.hint("merge"), "block")
    cells = met.mapInArrow(_cells(parts, n_main), "bucket int, pair int, word int, n long")
    cells = [tuple(r) for r in cells.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).collect()]
    weights = learn_weights(sorted(cells), types)
    out = met.mapInArrow(_score(parts, n_main + n_apart, types, weights, id_type), f"id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    return Scores(out.withColumnRenamed("id", id_col), n_main + n_apart, types, weights)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_mod("doc_id", 10)
    s = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold != 0, fold == 1)
    return s.frame.select("doc_id", (fold == 0).alias("held_out"), "n_tokens", "n_known", F.lit(s.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
