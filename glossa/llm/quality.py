"""Quality classification by compression.

Two zstandard dictionaries are built from good and from bad labelled text. A text is compressed with either,
in pieces of fixed size so that long texts don't become their own dictionary; the difference of the sizes,
over their sum, is calibrated to a probability by logistic regression on other labelled texts, together with
the share of the text that is left after compression, which repetition lowers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .hashing import chunks
from .packing import trim
from .shared import bounded_sample, crc_mod, within_bytes


@dataclass
class Model:
    good: bytes
    bad: bytes
    piece: int
    level: int
    weights: tuple[float, ...] = (0.0, 0.0)
    bias: float = 0.0

    def __post_init__(self):
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _sizes(self, text: bytes) -> tuple[int, int]:
        if self._ready is None:
            self._ready = []
            for d in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(d)
                d.precompute_compress(level=self.level)
                self._ready.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        pieces = [text[i : i + self.piece] for i in range(0, len(text), self.piece)]
        return tuple(sum(len(f(p)) for p in pieces) for f in self._ready)

    def features(self, text: bytes) -> tuple[float, float]:
        """How much smaller the text gets with the good dictionary, from -1 to 1, and the logarithm of the share that is left; 0 for the empty text."""
        good, bad = self._sizes(text)
        return ((bad - good) / (bad + good), float(np.log((bad + good) / 2 / len(text)))) if text else (0.0, 0.0)

    def score(self, text: bytes) -> float:
        x = sum(w * f for w, f in zip(self.weights, self.features(text), strict=True)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _dictionary(texts: list[bytes], piece: int, size: int) -> bytes:
    """A trained dictionary; too little text for training is taken as it is."""
    samples = [t[i : i + piece] for t in texts for i in range(0, len(t), piece)]
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"\n" * 8


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[tuple[float, ...], float]:
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
    return tuple((w[:-1] / scale).tolist()), float(w[-1])


def fit(texts: list[bytes], labels: list[int], piece: int = 1024, size: int = 112_640, level: int = 3) -> Model | None:
    """Every other text of a label goes into its dictionary, the rest into the calibration; None without texts."""
    if not texts:
        return None
    rows = {k: [t for t, x in zip(texts, labels, strict=True) if x == k] for k in (0, 1)}
    model = Model(*(_dictionary(rows[k][::2], piece, size) for k in (1, 0)), piece, level)
    x = np.array([model.features(t) for k in (0, 1) for t in rows[k][1::2] or rows[k]])
    y = np.array([float(k) for k in (0, 1) for _ in rows[k][1::2] or rows[k]])
    model.weights, model.bias = _logistic(x, y)
    return model


def train(docs: DataFrame, labels: DataFrame, held_out: Column, per_label: int = 3000, bytes_a_label: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> Model | None:
    """Fit on at most ``per_label`` whole texts of each label, of ``bytes_a_label`` together, chosen by the hash of the id among labels not held out.

    ``held_out`` is a condition on ``id_col``. Null labels, ids and texts are left out.
    """
    known = labels.filter(~held_out & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    some = bounded_sample(known, "label", "id", per_label)
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")
    rows = within_bytes(rows, "label", "text", bytes_a_label)
    rows = sorted((r["id"], r["label"], r["text"]) for r in rows.collect())
    counts = {k: sum(x[1] == k for x in rows) for k in (0, 1)}
    model = fit([t.encode() for _, _, t in rows], [x for _, x, _ in rows], **options)
    if model is not None and min(counts.values()):
        # the sample has as many of either label as it may; the corpus has not
        whole = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
        model.bias += float(np.log(whole[1] / whole[0]) - np.log(counts[1] / counts[0]))
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score (0 to 1, higher: label 1 likelier).

    Null and empty texts have no difference and get the calibration's intercept; without a model all scores
    are 0.5. Repeated rows and null ids are kept; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0.5).alias("score"))
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), rows.schema["id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches):
        for ids, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array([shared.value.score(t) for t in texts], pa.float64())], names=["id", "score"])
        trim()

    return rows.mapInArrow(run, f"id {kind.simpleString()}, score double").withColumnRenamed("id", id_col)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = crc_mod("doc_id", 3) == 1
    out = score(docs, train(docs, labels, held))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
