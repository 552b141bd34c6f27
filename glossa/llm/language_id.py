"""Language identification by string kernels.

The kernel of two texts is the blend, over n-gram lengths, of the cosine of their sets of present byte
n-grams (of three bytes and more: of their hashes of 16 bits). Nyström landmarks turn it into features, on
which one ridge regression a language is fitted against the rest. A batch of texts is scored by products of
its presence matrix with the landmarks'; only n-grams that no landmark has are left out of them, where they
add nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .hashing import CHUNK_BYTES, chunks
from .packing import ranges, trim
from .shared import bounded_sample, crc_mod, within_bytes

UNKNOWN = "und"
SLOTS = 1 << 16  # n-grams of three bytes and more are hashed to so many
BATCH = 256


def _codes(buf: np.ndarray, n: int) -> np.ndarray:
    """A 16-bit code of the n-gram at each position; the last n - 1 positions run into the end."""
    x = np.zeros(len(buf), np.uint32)
    for i in range(n):
        part = np.zeros(len(buf), np.uint32)
        part[: max(0, len(buf) - i)] = buf[i:]
        x = (x << np.uint32(8)) | part
    return x if n <= 2 else (x * np.uint32(2654435761)) >> np.uint32(16)


def _flat(texts: list[bytes], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, lower-cased and each followed by ``longest`` zeros; places of their own bytes, and the text of each."""
    gap = b"\0" * longest
    buf = np.frombuffer(b"".join([b" " + t.lower() + b" " + gap for t in texts]), np.uint8)
    lens = np.array([len(t) + 2 for t in texts], np.int64)
    return buf, ranges(np.cumsum(lens + longest) - lens - longest, lens), np.repeat(np.arange(len(texts)), lens)


def _present(texts: list[bytes], lengths):
    """For each n, which slots of n-grams each text has."""
    buf, at, row = _flat(texts, max(lengths))
    for n in lengths:
        x = np.zeros((len(texts), SLOTS), bool)
        x[row, _codes(buf, n)[at]] = True
        yield n, x


@dataclass
class Model:
    langs: list[str]
    slots: dict[int, np.ndarray]  # by n: slots that a landmark has
    marks: dict[int, np.ndarray]  # by n: presence in the landmarks, by these slots and landmark
    norms: dict[int, np.ndarray]  # by n: root of the landmarks' numbers of n-grams
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    least: float = 0.0  # a lower score is that of no language learned
    heads: dict[int, np.ndarray] | None = None  # by n: what each slot adds to the score of each language

    def kernel(self, texts: list[bytes]) -> np.ndarray:
        out = 0.0
        for n, x in _present(texts, tuple(self.slots)):
            own = np.sqrt(np.maximum(np.count_nonzero(x, axis=1), 1))
            out = out + (x[:, self.slots[n]].astype(np.float32) @ self.marks[n]) / own[:, None] / self.norms[n]
        return out / len(self.slots)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """One-versus-rest scores, from 0 to 1: the kernel times the weights, with the landmarks' part of it made once."""
        if self.heads is None:
            self.heads = {n: np.zeros((SLOTS, len(self.langs)), np.float32) for n in self.marks}
            for n, m in self.marks.items():
                self.heads[n][self.slots[n]] = m / self.norms[n] @ self.weights / len(self.slots)
            self.marks = {}
        out = self.bias
        for n, x in _present(texts, tuple(self.slots)):
            # presence times heads: the rows of the slots that are there, summed text by text
            at = np.flatnonzero(x)
            ends = np.searchsorted(at, np.arange(1, len(texts) + 1) * SLOTS)
            sums = np.concatenate((np.zeros((1, len(self.langs))), np.cumsum(self.heads[n][at % SLOTS], axis=0, dtype=np.float64)))
            own = np.diff(ends, prepend=0)
            out = out + (sums[ends] - sums[ends - own]) / np.sqrt(np.maximum(own, 1))[:, None]
        return np.clip((out + 1) / 2, 0, 1)


def fit(texts: list[bytes], langs: list[str], lengths=(1, 2, 3, 4), landmarks: int = 256, ridge: float = 0.1) -> Model | None:
    """Fit on texts with their languages; None without any. Landmarks are the first texts of each language in turn."""
    names = sorted(set(langs))
    if not names:
        return None
    each = max(1, landmarks // len(names))
    chosen = [i for name in names for i in [j for j, x in enumerate(langs) if x == name][:each]]
    marks, slots, norms = {}, {}, {}
    for n, there in _present([texts[i] for i in chosen], lengths):
        slots[n] = np.flatnonzero(there.any(axis=0))
        marks[n] = np.ascontiguousarray(there[:, slots[n]].T.astype(np.float32))
        norms[n] = np.sqrt(np.maximum(np.count_nonzero(there, axis=1), 1)).astype(np.float32)
    model = Model(names, slots, marks, norms)
    k = np.concatenate([model.kernel(texts[i : i + BATCH]) for i in range(0, len(texts), BATCH)]).astype(np.float64)
    kll = model.kernel([texts[i] for i in chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh((kll + kll.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = k @ root
    target = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    mean, centre = phi.mean(axis=0), target.mean(axis=0)
    beta = np.linalg.solve((phi - mean).T @ (phi - mean) + ridge * np.eye(phi.shape[1]), (phi - mean).T @ (target - centre))
    model.weights = (root @ beta).astype(np.float32)
    model.bias = (centre - mean @ beta).astype(np.float32)
    # a quarter of the way from the score of a text that shares nothing with any landmark, or of the empty text if that is less, to the lowest of texts told rightly
    told = np.clip((k @ model.weights + model.bias + 1) / 2, 0, 1)
    right = told.max(axis=1)[target[np.arange(len(texts)), told.argmax(axis=1)] > 0]
    nothing = min(float(np.clip((model.bias + 1) / 2, 0, 1).max()), float(model.scores([b""]).max()))
    model.least = min(nothing, float(right.min())) * 0.75 + float(right.min()) * 0.25 if len(right) else 0.0
    return model


def train(docs: DataFrame, held_out: Column, per_language: int = 400, bytes_a_language: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model | None:
    """Fit on at most ``per_language`` whole texts of each language, of ``bytes_a_language`` together, chosen by the hash of the id among the rows not held out."""
    rows = docs.filter(~held_out & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    ids = bounded_sample(rows.select("id", "lang"), "lang", "id", per_language).select("id")
    some = within_bytes(rows.join(F.broadcast(ids), "id", "left_semi"), "lang", "text", bytes_a_language)
    some = sorted((r["id"], r["lang"], r["text"]) for r in some.select("id", "lang", "text").collect())
    return fit([t.encode() for _, _, t in some], [x for _, x, _ in some], **options)


def _scored(model, kind):
    def run(batches):
        for ids, texts in chunks(batches, CHUNK_BYTES // 2):
            for i in range(0, len(ids), BATCH):
                s = model.value.scores(texts[i : i + BATCH])
                best = s.argmax(axis=1)
                langs = [model.value.langs[b] for b in best]
                cols = [pa.array(ids[i : i + BATCH], kind), pa.array(langs, pa.string()), pa.array(s.max(axis=1).astype(np.float64), pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "lang_pred", "score"])
        trim()

    return run


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score (0 to 1, the largest one-versus-rest score).

    Texts that are null or without a letter, and all texts without a model, are ``und`` with score 0. Equal
    scores go to the language first by code point. Repeated rows and null ids are kept; other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    none = rows.select("id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("some"))
    if model is None:
        return none.drop("some").withColumnRenamed("id", id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    blank = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = rows.select("id", F.when(blank, F.col("text")).alias("text"))
    out = rows.mapInArrow(_known(_scored(shared, to_arrow_type(kind)), to_arrow_type(kind)), f"id {kind.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def _known(scored, kind):
    """Rows with a text are scored; the others, null by now, are unknown."""

    def run(batches):
        for batch in batches:
            there = batch.column(1).is_valid()
            for part in scored([batch.filter(there)]):
                yield part
            ids = batch.column(0).filter(pa.compute.invert(there))
            yield pa.RecordBatch.from_arrays([ids.cast(kind), pa.array([UNKNOWN] * len(ids), pa.string()), pa.array([0.0] * len(ids), pa.float64())], names=["id", "lang_pred", "score"])

    import pyarrow.compute  # noqa: F401  pa.compute in run

    return run


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, train(docs, crc_mod("doc_id", 4) == 2))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def filter_known(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a letter and a language with the model's least score or more.

    That score is calibrated on the texts learned from, whatever the number of languages: all of these that
    are told rightly stay. Without a model only texts that are null or without a letter go. An empty table
    gives no rows; repeated rows are judged alike.
    """
    rows = docs.filter(F.col(text_col).rlike(r"\p{L}"))
    if model is None:
        return rows
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                some = batch.slice(i, BATCH)
                texts = pa.RecordBatch.from_arrays([pa.array(range(len(some))), some.column(at)], names=["id", "text"])
                best = np.concatenate([shared.value.scores(t).max(axis=1) for _, t in chunks([texts], CHUNK_BYTES // 2)])
                yield some.filter(pa.array(best >= shared.value.least))
            del batch, some, texts
            trim()

    return rows.mapInArrow(run, docs.schema)
