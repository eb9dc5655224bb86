"""Fits on logged transitions, chosen by a validation part. Sums are made on executors; rows never reach the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from .sampling import train_val_split_exact


def features(vector: Column) -> Column:
    """An array column as the input vector of the fitted pipelines (column ``raw``)."""
    return array_to_vector(vector)


def split_rows(df: DataFrame, row_id: str = "prompt_id", seed: int = 42, val_split: float = 0.1) -> DataFrame:
    """Rows with their ``split``, written once to the shared folder and read by scaler, fit and evaluation."""
    path = scratch_dir(df.sparkSession, "split")
    rows = train_val_split_exact(df, row_id, seed, val_split)
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def _parts(split: DataFrame, vector: Column, label: Column) -> tuple[DataFrame, DataFrame]:
    rows = split.select("split", features(vector).alias("raw"), label.cast("double").alias("label"))
    return rows.where(F.col("split") == "train"), rows.where(F.col("split") == "val")


def _pipeline(estimator) -> Pipeline:
    return Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
                            estimator])


@dataclass(frozen=True)
class Fit:
    """A model chosen by its validation loss: which iteration (or candidate) was chosen, and the losses of all that were run.

    ``history`` has (iteration, training loss, validation loss) rows; a model without iterations has one.
    """
    model: object
    val_loss: float
    chosen: int
    history: list[tuple[int, float, float]]


@dataclass(frozen=True)
class LinearModel:
    """Weights of an intercept and the features (rows) for each output (columns)."""
    weights: np.ndarray

    def predict(self, x: Column) -> Column:
        """All outputs as ARRAY<DOUBLE>."""
        terms = [F.lit(1.0), *[F.get(x, F.lit(i)) for i in range(len(self.weights) - 1)]]
        return F.array(*[reduce(add, [t * float(w) for t, w in zip(terms, column)]) for column in self.weights.T])


def grams(split: DataFrame, x: Column, y: Column) -> dict[str, np.ndarray]:
    """For each part of ``split_rows`` the products of (1, features, outputs) with each other, summed over its rows.

    One scan: a task adds up matrix products of its batches, and the sums of all tasks are summed by Spark; what reaches the
    driver is the square of the width, whatever the rows. Rows without a vector take no part.
    """
    rows = split.select("split", F.concat(F.array(F.lit(1.0)), x, y).cast("array<double>").alias("z")).where("z IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, z = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths = np.unique(z.value_lengths().to_numpy(zero_copy_only=False))
            if len(lengths) > 1:
                raise ValueError(f"rows differ in width: {lengths.tolist()}")
            if batch.num_rows:
                matrix = z.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for name in np.unique(names):
                    some = matrix[names == name]
                    sums[name] = sums.get(name, 0.0) + some.T @ some
        for name, gram in sums.items():
            i, j = np.indices(gram.shape)
            yield pa.RecordBatch.from_pydict({"split": [name] * gram.size, "i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32),
                                              "value": gram.ravel()})

    summed = rows.mapInArrow(run, "split string, i int, j int, value double").groupBy("split", "i", "j").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    found = summed.collect()  # the square of the width for each part
    width = 1 + max((r["i"] for r in found), default=-1)
    for r in found:
        out.setdefault(r["split"], np.zeros((width, width)))[r["i"], r["j"]] = r["value"]
    return out


def _squared_errors(gram: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean squared error of each output, from sums of products alone."""
    p, n = len(weights), max(gram[0, 0], 1.0)
    fitted = np.einsum("pm,pq,qm->m", weights, gram[:p, :p], weights)
    return np.maximum(np.diag(gram[p:, p:]) - 2 * (weights * gram[:p, p:]).sum(axis=0) + fitted, 0.0) / n


def least_squares(parts: dict[str, np.ndarray], outputs: int) -> tuple[LinearModel, np.ndarray]:
    """The exact fit of all outputs on the training part, solved once, and each output's mean squared validation error."""
    gram = parts["train"]
    p = len(gram) - outputs
    scale = 1.0 / np.sqrt(np.maximum(np.diag(gram)[:p], 1e-300))
    solved, *_ = np.linalg.lstsq(gram[:p, :p] * scale[:, None] * scale, gram[:p, p:] * scale[:, None], rcond=1e-13)
    weights = solved * scale[:, None]
    return LinearModel(weights), _squared_errors(parts.get("val", np.zeros_like(gram)), weights)


def descend(parts: dict[str, np.ndarray], rate: float = 1.0, epochs: int = 60, patience: int = 5, min_delta: float = 0.0) -> Fit:
    """Least squares by full-batch gradient steps from zero, stopped by the validation part; one output.

    An epoch is one step on all training rows, which needs only their sums of products. The best epoch is the last whose
    validation loss fell below the best before it by more than ``min_delta``; ``patience`` epochs in a row that do not end
    the run, and the best epoch's weights are the model.
    """
    train, val = parts["train"], parts["val"]
    p, n = len(train) - 1, train[0, 0]
    weights, best, history = np.zeros((p, 1)), (np.inf, 0, np.zeros((p, 1))), []
    for epoch in range(1, epochs + 1):
        weights = weights - rate * (train[:p, :p] @ weights - train[:p, p:]) / n
        history.append((epoch, float(_squared_errors(train, weights)[0]), float(_squared_errors(val, weights)[0])))
        if history[-1][2] < best[0] - min_delta:
            best = (history[-1][2], epoch, weights)
        elif epoch - best[1] >= patience:
            break
    return Fit(LinearModel(best[2]), best[0], best[1], history)


def fit_reward_regressor(split: DataFrame, kind: str = "descent", **options) -> Fit:
    """Learn reward from (state, action) of the rows of ``split_rows``; losses are mean squared errors.

    ``linear`` is the exact fit; ``descent`` stops gradient steps, and ``gbt`` stops boosting, where the validation part says
    so. Boosting's validation loss is that of the chosen number of trees, and its history that of every number.
    """
    if kind in ("linear", "descent"):
        parts = grams(split, F.concat("observation", "action"), F.array(F.col("reward").cast("double")))
        if kind == "descent":
            return descend(parts, **options)
        model, errors = least_squares(parts, 1)
        train = float(_squared_errors(parts["train"], model.weights)[0])
        return Fit(model, float(errors[0]), 1, [(1, train, float(errors[0]))])
    if kind != "gbt":
        raise ValueError("kind must be 'linear', 'descent' or 'gbt'")
    rows = split.select((F.col("split") == "val").alias("is_val"), features(F.concat("observation", "action")).alias("raw"),
                        F.col("reward").cast("double").alias("label"))
    booster = GBTRegressor(**{"maxIter": 20, "seed": 7, "validationTol": 0.01, **options}, validationIndicatorCol="is_val")
    model = _pipeline(booster).fit(rows)
    trees, scaled = model.stages[-1], model.stages[0].transform(rows)
    losses = zip(*[trees.evaluateEachIteration(scaled.where(part), "squared") for part in ("NOT is_val", "is_val")])
    history = [(k + 1, a, b) for k, (a, b) in enumerate(losses)]
    return Fit(model, history[-1][2], trees.getNumTrees, history)


def fit_bc_continuous(split: DataFrame, dim: int) -> tuple[LinearModel, np.ndarray]:
    """Learn all ``dim`` action dimensions from the observation: one scan, one system. Returns model and validation MSEs."""
    parts = grams(split, F.col("observation"), F.slice("action", 1, dim))
    return least_squares(parts, dim)


def fit_bc_discrete(split: DataFrame, n_actions: int, obs_dim: int, kind: str = "logistic", seed: int = 42,
                    penalties: Sequence[float] = (0.0,)) -> Fit:
    """Learn discrete actions by cross entropy; losses are 0-1 losses.

    Of several ``penalties`` (of the squared weights, logistic only) the first with the least validation loss is chosen, and
    ``chosen`` counts it from 1.
    """
    train, val = _parts(split, F.col("observation"), F.col("action_disc"))
    if kind == "logistic":
        estimators = [LogisticRegression(maxIter=100, tol=1e-9, regParam=p) for p in penalties]
    elif kind == "mlp":
        estimators = [MultilayerPerceptronClassifier(layers=[obs_dim, 64, 64, n_actions], seed=seed, maxIter=50)]
    else:
        raise ValueError("kind must be 'logistic' or 'mlp'")
    models = [_pipeline(e).fit(train) for e in estimators]
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy")
    history = [(k + 1, 1.0 - accuracy.evaluate(m.transform(train)), 1.0 - accuracy.evaluate(m.transform(val))) for k, m in enumerate(models)]
    chosen = min(history, key=lambda h: (h[2], h[0]))
    return Fit(models[chosen[0] - 1], chosen[2], chosen[0], history)
