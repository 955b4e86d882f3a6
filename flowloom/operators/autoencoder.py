"""Reconstruction model: distributed fit, scoring, prediction.

A symmetric multi-layer perceptron with ReLU on every layer but the last. Weights
are a few thousand doubles; they travel to the tasks inside the function, and
rows never leave the executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.profile import scale_columns

ERROR_COLUMN = "anomaly_score"


@dataclass(frozen=True)
class Network:
    """Layer matrices (inputs x outputs) and bias vectors."""

    weights: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]

    @property
    def shapes(self) -> list[tuple[int, int]]:
        return [w.shape for w in self.weights]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for pair in zip(self.weights, self.biases) for a in pair])

    @staticmethod
    def from_flat(values: np.ndarray, shapes: Sequence[tuple[int, int]]) -> Network:
        weights, biases, at = [], [], 0
        for rows, cols in shapes:
            weights.append(values[at : at + rows * cols].reshape(rows, cols))
            at += rows * cols
            biases.append(values[at : at + cols])
            at += cols
        return Network(tuple(weights), tuple(biases))

    @staticmethod
    def start(dims: Sequence[int], seed: int = 42) -> Network:
        """Uniform start in +-1/sqrt(inputs), encoder mirrored by the decoder."""
        layout = list(dims) + list(dims)[-2::-1]
        rng = np.random.default_rng(seed)
        weights, biases = [], []
        for rows, cols in zip(layout[:-1], layout[1:]):
            bound = 1.0 / np.sqrt(rows)
            weights.append(rng.uniform(-bound, bound, (rows, cols)))
            biases.append(rng.uniform(-bound, bound, cols))
        return Network(tuple(weights), tuple(biases))

    def activations(self, x: np.ndarray) -> list[np.ndarray]:
        out, last = [x], len(self.weights) - 1
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            z = out[-1] @ w + b
            out.append(z if i == last else np.maximum(z, 0.0))
        return out

    def errors(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.activations(x)[-1]) ** 2).mean(axis=1)

    def gradient(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean squared error of a batch and its gradient, flat."""
        acts = self.activations(x)
        diff = acts[-1] - x
        delta = 2.0 * diff / diff.size
        parts = []
        for i in range(len(self.weights) - 1, -1, -1):
            parts += [delta.sum(axis=0), (acts[i].T @ delta).ravel()]
            if i:
                delta = (delta @ self.weights[i].T) * (acts[i] > 0)
        return float((diff**2).mean()), np.concatenate(parts[::-1])

    def to_json(self) -> str:
        return json.dumps({"shapes": self.shapes, "values": self.flat().tolist()})

    @staticmethod
    def from_json(text: str) -> Network:
        data = json.loads(text)
        return Network.from_flat(np.array(data["values"]), [tuple(s) for s in data["shapes"]])


@dataclass(frozen=True)
class TrainingConfig:
    dims: tuple[int, ...] = (67, 32, 16)
    learning_rate: float = 1e-3
    steps_per_epoch: int = 8
    max_epochs: int = 100
    patience: int = 10
    seed: int = 42


@dataclass
class TrainingResult:
    network: Network
    history: list[dict] = field(default_factory=list)
    best_epoch: int = 0


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return pdf.to_numpy(dtype=np.float64)


def fit(train: DataFrame, validation: DataFrame, features: Sequence[str], cfg: TrainingConfig, start: Network | None = None) -> TrainingResult:
    """Fit on benign rows; stop when the benign validation loss stalls.

    Adam with synchronous steps: a hash of its values and the epoch deals every row to one of
    ``steps_per_epoch`` steps, each step is one Spark job that sums the gradient over
    its rows, and only that sum returns. How the rows are partitioned does not
    matter, and a lost executor repeats only its part of one step.
    """
    network = start or Network.start(cfg.dims, cfg.seed)
    shapes, w = network.shapes, network.flat()
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    best, best_loss, waited = network, float("inf"), 0
    result = TrainingResult(network)
    # Read once per step: kept on the executors, recomputed where one is lost.
    rows = train.select(*[F.col(f"`{c}`").cast("double") for c in features]).persist(StorageLevel.MEMORY_AND_DISK)
    held = validation.select(*[F.col(f"`{c}`").cast("double") for c in features]).persist(StorageLevel.MEMORY_AND_DISK)
    for epoch in range(1, cfg.max_epochs + 1):
        seen, loss_sum = 0.0, 0.0
        for step in range(cfg.steps_per_epoch):
            dealt = F.pmod(F.xxhash64(F.lit(cfg.seed + epoch), *rows.columns), F.lit(cfg.steps_per_epoch)) == step
            got = _gradient(rows.filter(dealt), Network.from_flat(w, shapes))
            if got is None:
                continue
            n, loss, g = got
            seen, loss_sum, t = seen + n, loss_sum + loss, t + 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w = w - cfg.learning_rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if not seen:
            raise ValueError("no training rows")
        network = Network.from_flat(w, shapes)
        loss = held.transform(add_error(network, features)).agg(F.avg(ERROR_COLUMN)).first()[0]
        result.history.append({"epoch": epoch, "train_loss": loss_sum / seen, "val_loss": loss})
        if loss is not None and loss < best_loss:
            best, best_loss, waited, result.best_epoch = network, loss, 0, epoch
        else:
            waited += 1
            if waited >= cfg.patience:
                break
    rows.unpersist()
    held.unpersist()
    result.network = best
    return result


def _gradient(rows: DataFrame, network: Network) -> tuple[float, float, np.ndarray] | None:
    """``(rows, summed loss, mean gradient)``; what returns has the size of the weights."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                x = _matrix(pdf.iloc[at : at + 4096])
                loss, g = network.gradient(x)
                part = np.concatenate([g, [loss, 1.0]]) * len(x)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"position": np.arange(len(total)), "value": total})

    parts = rows.mapInPandas(sums, "position long, value double").groupBy("position").agg(F.sum("value").alias("value"))
    table = parts.toPandas().sort_values("position")["value"].to_numpy()
    if not len(table):
        return None
    return float(table[-1]), float(table[-2]), table[:-2] / table[-1]


def add_error(network: Network, features: Sequence[str], column: str = ERROR_COLUMN):
    """Transform adding the mean squared reconstruction error of scaled features."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(network.errors(np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])))

    return lambda df: df.withColumn(column, score(*[F.col(f"`{c}`").cast("double") for c in features]))


def error_expression(network: Network, features: Sequence[str]) -> Column:
    """The same error as one Column expression, for very small networks."""
    x = [F.col(f"`{c}`").cast("double") for c in features]
    layer = x
    last = len(network.weights) - 1
    for i, (w, b) in enumerate(zip(network.weights, network.biases)):
        outputs = []
        for j in range(w.shape[1]):
            z = F.lit(float(b[j]))
            for k in range(w.shape[0]):
                z = z + layer[k] * F.lit(float(w[k, j]))
            outputs.append(z if i == last else F.greatest(z, F.lit(0.0)))
        layer = outputs
    total = F.lit(0.0)
    for a, r in zip(x, layer):
        total = total + (a - r) * (a - r)
    return total / F.lit(float(len(x)))


def predict(df: DataFrame, scaler: DataFrame, network: Network, features: Sequence[str], threshold: float | Column) -> DataFrame:
    """Scale, score and flag; the raw features stay untouched in the output.

    Adds ``anomaly_score``, ``reconstruction_error``, ``is_anomaly`` and
    ``threshold_used``.
    """
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    names = [f"_x{i}" for i in range(len(features))]
    copies = df.withColumns({n: F.col(f"`{c}`").cast("double") for n, c in zip(names, features)})
    renamed = scaler.withColumn("feature", F.concat(F.lit("_x"), F.col("position").cast("string")))
    scored = scale_columns(copies, renamed, names).transform(add_error(network, names)).drop(*names)
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return scored.withColumns(
        {
            "reconstruction_error": F.col(ERROR_COLUMN),
            "is_anomaly": F.col(ERROR_COLUMN) >= limit,
            "threshold_used": limit,
        }
    )


def impute_features(df: DataFrame, scaler: DataFrame, features: Sequence[str], source: str = "features") -> DataFrame:
    """Columns from a feature map; absent keys take the training mean.

    ``imputed_features`` names what was filled. The scaler table (one row per
    feature) enters as a scalar subquery.
    """
    entry = F.map_from_entries(F.collect_list(F.struct("feature", "mean")))
    staged = df.withColumn("_means", scaler.agg(entry.alias("m")).scalar())
    given = F.map_keys(source)
    filled = {c: F.coalesce(F.try_element_at(F.col(source), F.lit(c)), F.element_at("_means", F.lit(c))) for c in features}
    names = F.array_compact(F.array(*[F.when(~F.array_contains(given, c), F.lit(c)) for c in features]))
    return staged.withColumns({**filled, "imputed_features": names}).drop("_means")
