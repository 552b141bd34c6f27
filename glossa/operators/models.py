"""Trained taggers: Spark ML models, Viterbi decoding, cross-validation and importances."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as mc
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..sources.working import written
from .core import confusion, folds, overall, ranked, union_all

#: Algorithms by name; boosted trees are binary, so they are fitted one against the rest.
ALGORITHMS = {
    "rf": lambda seed: mc.RandomForestClassifier(numTrees=20, maxDepth=7, seed=seed),
    "dt": lambda seed: mc.DecisionTreeClassifier(maxDepth=7, seed=seed),
    "lr": lambda seed: mc.LogisticRegression(maxIter=20),
    "nb": lambda seed: mc.NaiveBayes(modelType="gaussian"),
    "gbt_ovr": lambda seed: mc.OneVsRest(classifier=mc.GBTClassifier(maxIter=10, maxDepth=3, seed=seed)),
    "linear_svc_ovr": lambda seed: mc.OneVsRest(classifier=mc.LinearSVC(maxIter=10)),
}
SCORERS = ("accuracy", "weighted_f1", "balanced_accuracy")


def _classifier(algorithm: str, seed: int, params: dict | None = None):
    """A classifier with its parameters set; those of one against the rest go to the classifier inside."""
    out = ALGORITHMS[algorithm](seed)
    inner = out.getClassifier() if isinstance(out, mc.OneVsRest) else out
    inner._set(**(params or {}))
    return out


def fit_tagger(rows: DataFrame, algorithm: str = "rf", columns: list[str] | None = None, vec: str = "vec", label: str = "label", seed: int = 209, params: dict | None = None):
    """Fit on feature columns, or on a vector column kept as an array. Rows with a null feature are left out.

    A fit reads its rows once a pass, so that they are written first.
    """
    rows = written(rows.select(*(columns or [vec]), F.col(label).cast("double").alias("label")), "features")
    last = _classifier(algorithm, seed, params).setFeaturesCol("features")
    if columns is None:
        return _WithVector(Pipeline(stages=[last]).fit(rows.withColumn("features", array_to_vector(F.col(vec)))), vec)
    parts = [VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features")]
    return Pipeline(stages=[*parts, last]).fit(rows)


class _WithVector:
    def __init__(self, model: PipelineModel, vec: str):
        self.model, self.vec = model, vec

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows.withColumn("features", array_to_vector(F.col(self.vec))))


def save_tagger(model, path: str) -> None:
    """Write a model of ``fit_tagger`` in either form, over what is there."""
    inner = model.model if isinstance(model, _WithVector) else model
    inner.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(model.vec if isinstance(model, _WithVector) else "",)], "vec string").write.mode("overwrite").json(f"{path}/form")


def load_tagger(spark: SparkSession, path: str):
    """A model that ``save_tagger`` wrote."""
    vec = spark.read.schema("vec string").json(f"{path}/form").first()["vec"]
    model = PipelineModel.load(f"{path}/model")
    return _WithVector(model, vec) if vec else model


def measures(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row of the three scorers: accuracy, weighted F1, and the mean recall over labels that occur."""
    p = predictions.select(F.col(label).cast("double").alias("a"), F.col(prediction).cast("double").alias("p"))
    return overall(confusion(p, "a", "p")).select(*SCORERS)


def cross_validate(rows: DataFrame, key: str, k: int = 5, algorithm: str = "rf", label: str = "label", seed: int = 209, group: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold predictions, a row a fold with the three scorers), with stratified folds, or folds of whole groups."""
    rows = folds(rows, key, k, seed, group=group) if group else folds(rows, key, k, seed, label)
    rows = rows.persist()  # each fold reads it twice; lost blocks are made again from its lineage
    out = []
    for i in range(k):
        held = rows.filter(F.col("fold") == i).withColumn("label", F.col(label).cast("double"))
        out.append(fit_tagger(rows.filter(F.col("fold") != i), algorithm, label=label, seed=seed, **options).transform(held).select(key, "label", "prediction", "fold"))
    scores = union_all([measures(p).select(F.lit(i).alias("fold"), *SCORERS) for i, p in enumerate(out)])
    return union_all(out), scores


def grid_search(rows: DataFrame, key: str, grid: dict[str, list], algorithm: str = "rf", refit: str = "weighted_f1", **options):
    """(model, table): the model of the best parameters, fitted on all rows, and the table of all of them.

    ``grid`` has the values of each parameter of the algorithm; every combination is cross-validated. The table
    has a row a combination: params (JSON), mean and standard deviation over the folds of each scorer, and rank
    by the mean of ``refit``, the first of equal ones first. ``refit="macro_recall"`` is balanced_accuracy.
    """
    names = sorted(grid)
    tables, combinations = [], [dict(zip(names, values, strict=True)) for values in itertools.product(*(grid[n] for n in names))]
    for i, params in enumerate(combinations):
        _, scores = cross_validate(rows, key, algorithm=algorithm, params=params, **options)
        each = [f(c).alias(f"{kind}_{c}") for c in SCORERS for kind, f in (("mean", F.avg), ("std", F.stddev_pop))]
        tables.append(scores.agg(*each).select(F.lit(i).alias("number"), F.lit(json.dumps(params)).alias("params"), "*"))
    found = union_all(tables).collect()  # a row a combination
    order = sorted(found, key=lambda r: (-r[f"mean_{refit}"], r["number"]))
    rank = {r["number"]: j + 1 for j, r in enumerate(order)}
    spark = rows.sparkSession
    table = spark.createDataFrame([(*r, rank[r["number"]]) for r in found], [*found[0].asDict(), "rank"])
    own = {k: v for k, v in options.items() if k in ("columns", "vec", "label", "seed")}
    return fit_tagger(rows, algorithm, params=combinations[order[0]["number"]], **own), table


def best_of(rows: DataFrame, key: str, algorithms: list[str], scorer: str = "weighted_f1", **options) -> str:
    """The algorithm with the best mean of a scorer; the first of equal ones."""
    return max(algorithms, key=lambda a: cross_validate(rows, key, algorithm=a, **options)[1].agg(F.avg(scorer)).first()[0])


def permutation_importance(model, rows: DataFrame, columns: list[str], label: str, key: str, seed: int = 209) -> DataFrame:
    """(feature, accuracy, weighted_f1, balanced_accuracy): what each loses when the column's values are dealt out anew.

    The row at each place of one hash order gets the value of the row at that place of another, so values
    move across all rows, and ranks are made within bins of the hash. A row is predicted once as it is and once a
    column, in one pass and one plan, whose size doesn't grow with the columns; only counts of labels are shuffled.
    """
    to = ranked(rows, key, seed).drop("_total")
    dealt = ranked(rows, key, seed + 1).select("_rank", *[F.col(c).alias(f"_p_{c}") for c in columns])
    met = to.join(dealt, "_rank").withColumn("_at", F.explode(F.sequence(F.lit(-1), F.lit(len(columns) - 1))))
    other = met.withColumns({c: F.when(F.col("_at") == i, F.col(f"_p_{c}")).otherwise(F.col(c)) for i, c in enumerate(columns)}).drop("_rank", *[f"_p_{c}" for c in columns])
    found = model.transform(other).groupBy("_at", F.col(label).cast("double").alias("actual"), F.col("prediction").cast("double").alias("predicted")).agg(F.count("*").alias("cnt"))
    each = F.struct("_at", *SCORERS)
    all_of = overall(found, "_at").agg(F.collect_list(F.when(F.col("_at") >= 0, each)).alias("e"), F.first(F.when(F.col("_at") < 0, each), ignorenulls=True).alias("w"))  # a row a column
    names = F.array(*map(F.lit, columns))
    return all_of.select("w", F.explode("e").alias("e")).select(F.get(names, F.col("e._at")).alias("feature"), *[(F.col(f"w.{x}") - F.col(f"e.{x}")).alias(x) for x in SCORERS])


def tagger_slot(load: Callable[[], Callable], returns: str = "array<string>"):
    """A pandas UDF from arrays of words to arrays of tags by a model that ``load`` makes once a Python worker.

    ``load()`` gives a function from a list of word lists to a list of tag lists; it is called with a batch.
    """

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for words in batches:
            yield pd.Series(model([list(w) if w is not None else [] for w in words]))

    return run


def best_paths(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """(sequences, n): the best path of each sequence of emissions (sequences, n, tags)."""
    score, back = e[:, 0], []
    for t in range(1, e.shape[1]):
        step = score[:, :, None] + trans
        back.append(step.argmax(axis=1))
        score = step.max(axis=1) + e[:, t]
    path = [score.argmax(axis=1)]
    for b in reversed(back):
        path.append(np.take_along_axis(b, path[-1][:, None], axis=1)[:, 0])
    return np.stack(path[::-1], axis=1)


def viterbi(n_tags: int, transitions: np.ndarray | None = None):
    """A pandas UDF from emissions (array<array<double>>) to the best path of tag numbers."""
    trans = np.zeros((n_tags, n_tags)) if transitions is None else np.asarray(transitions, float)

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        lens = s.map(lambda x: 0 if x is None else len(x)).to_numpy()
        out = np.empty(len(s), object)
        for n in np.unique(lens).tolist():  # sequences of one length at once
            at = np.flatnonzero(lens == n)
            if not n:
                for i in at:
                    out[i] = []
                continue
            e = np.stack([np.stack(s.iloc[i]) for i in at]).astype(float)
            for i, p in zip(at, best_paths(e, trans), strict=True):
                out[i] = p.tolist()
        return pd.Series(out)

    return run


def sequence_loss(emissions: np.ndarray, tags: np.ndarray, transitions: np.ndarray) -> float:
    """Negative log likelihood of a tag sequence under a linear chain; steps whose tag is -100 are left out."""
    keep = tags != -100
    emissions, tags = emissions[keep], tags[keep]
    if not len(tags):
        return 0.0
    total, path = emissions[0], emissions[0][tags[0]]
    for t in range(1, len(tags)):
        step = total[:, None] + transitions
        top = step.max(axis=0)
        total = top + np.log(np.exp(step - top).sum(axis=0)) + emissions[t]
        path += transitions[tags[t - 1], tags[t]] + emissions[t][tags[t]]
    top = total.max()
    return float(top + np.log(np.exp(total - top).sum()) - path)


def fit_transitions(sequences: DataFrame, tags: str = "tags", labels: list[str] | None = None, smooth: float = 1.0) -> np.ndarray:
    """Log transition probabilities between neighbouring tags; a few counts reach the driver."""
    pairs = sequences.select(F.explode(F.arrays_zip(F.slice(tags, 1, F.size(tags) - 1).alias("a"), F.slice(tags, 2, F.size(tags)).alias("b"))).alias("p"))
    out = np.full((len(labels), len(labels)), smooth)
    for r in pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).collect():
        out[labels.index(r["a"]), labels.index(r["b"])] += r["n"]
    return np.log(out / out.sum(axis=1, keepdims=True))
