"""Batch scoring of trained networks: Arrow batches in, NumPy matrix products, Arrow batches out."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..schemas import VECTOR

MAX_PARAMETERS = 100_000_000

_ACTIVATIONS = {
    "relu": lambda x: np.maximum(x, 0.0),
    "tanh": np.tanh,
    "sigmoid": lambda x: 1.0 / (1.0 + np.exp(-x)),
    "leaky_relu": lambda x: np.where(x > 0, x, 0.01 * x),
    "id": lambda x: x,
}


@dataclass(frozen=True)
class Network:
    """Layers by head; ``body`` is shared, other heads continue from it."""

    heads: dict[str, list[tuple[np.ndarray, np.ndarray, str]]]

    @property
    def input_dim(self) -> int:
        return self.heads["body" if self.heads.get("body") else next(iter(self.heads))][0][0].shape[1]

    def run(self, x: np.ndarray, heads: list[str]) -> list[np.ndarray]:
        common = _forward(x, self.heads.get("body", []))
        return [_forward(common, self.heads[h]) for h in heads]


def _forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray, str]]) -> np.ndarray:
    for w, b, activation in layers:
        x = _ACTIVATIONS[activation](x @ w.T + b)
    return x


def fold_batch_norm(w: np.ndarray, b: np.ndarray, gamma: np.ndarray, beta: np.ndarray, mean: np.ndarray,
                    var: np.ndarray, eps: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a linear layer with the batch norm behind it, by running statistics."""
    k = gamma / np.sqrt(var + eps)
    return w * k[:, None], (b - mean) * k + beta


def load_network(weights: DataFrame) -> Network:
    """Read the layers table (schemas.LAYER). Its size is checked before it reaches the driver."""
    size = weights.agg(F.sum(F.size("w").cast("bigint") * F.size(F.col("w")[0])).alias("n")).first()["n"] or 0
    if size > MAX_PARAMETERS:
        raise ValueError(f"network of {size} parameters is above the limit of {MAX_PARAMETERS}")
    heads: dict[str, list] = {}
    for row in weights.orderBy("head", "layer").collect():
        if row["activation"] not in _ACTIVATIONS:
            raise ValueError(f"Unsupported activation: {row['activation']}")
        heads.setdefault(row["head"], []).append((np.array(row["w"]), np.array(row["b"]), row["activation"]))
    return Network(heads)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Valid-row mask and the matrix of valid rows of a list column."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    rows = column.drop_null()
    lengths = np.unique(rows.value_lengths().to_numpy(zero_copy_only=False))
    if len(rows) and (len(lengths) != 1 or lengths[0] != width):
        raise ValueError(f"Expected input dimension {width}, but got {lengths.tolist()}")
    return valid, rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)


def _lists(valid: np.ndarray, values: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.where(valid, values.shape[1], 0))]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1), pa.float64()),
                                    mask=pa.array(~valid))


def score_mlp_policy(spark, network: Network, observation: Column, head: str = "out") -> Column:
    """Deterministic network output as ARRAY<DOUBLE>; NULL input stays NULL."""
    shared = spark.sparkContext.broadcast(network)

    @F.arrow_udf(VECTOR)
    def score(x: pa.Array) -> pa.Array:
        net = shared.value
        valid, matrix = _matrix(x, net.input_dim)
        return _lists(valid, net.run(matrix, [head])[0])

    return score(observation)


def score_gaussian_policy(spark, network: Network, observation: Column) -> Column:
    """STRUCT<mean, std> from the heads ``mean`` and ``log_std`` on a shared body."""
    shared = spark.sparkContext.broadcast(network)

    @F.arrow_udf(VECTOR)
    def score(x: pa.Array) -> pa.Array:
        net = shared.value
        valid, matrix = _matrix(x, net.input_dim)
        mean, log_std = net.run(matrix, ["mean", "log_std"])
        return _lists(valid, np.concatenate([mean, np.exp(log_std)], axis=1))

    dim = network.heads["mean"][-1][1].shape[0]
    both = score(observation)
    return F.struct(F.slice(both, 1, dim).alias("mean"), F.slice(both, dim + 1, dim).alias("std"))


def policy_action(network: Network, observation: Column, distribution: Column) -> Column:
    """Mode of a Gaussian policy; a row already of action size passes through."""
    dim = network.heads["mean"][-1][1].shape[0]
    return F.when(F.size(observation) == dim, observation).otherwise(distribution["mean"])


def with_statistics(network: Network, stats: Row, head: str = "out") -> Network:
    """A reward network with its statistics inside: inputs are scaled by the first layer, rewards by the last, linear one.

    ``stats`` is the row of ``normalization_stats``. Statistics that were never set raise.
    """
    mean, std = (np.array([*stats[f"state_{k}"], *stats[f"action_{k}"]], float) for k in ("mean", "std"))
    if ((mean == 0).all() and (std == 1).all()) or (stats["reward_mean"] == 0 and stats["reward_std"] == 1):
        raise ValueError("normalization statistics have not been updated")
    layers = list(network.heads[head])
    if network.heads.get("body") or layers[-1][2] != "id":
        raise ValueError("only a network of one head with a linear end takes statistics")
    w, b, activation = layers[0]
    w = w / (std + 1e-8)
    layers[0] = (w, b - w @ mean, activation)
    w, b, activation = layers[-1]
    layers[-1] = (w * stats["reward_std"], b * stats["reward_std"] + stats["reward_mean"], activation)
    return Network({head: layers})


def score_reward_model(spark, network: Network, state: Column, action: Column, stats: Row | None = None, head: str = "out") -> Column:
    """Normalise, concatenate, run the network, denormalise. NULL state or action gives NULL.

    ``stats`` is the row of ``normalization_stats``, folded into the network; without it nothing is scaled.
    """
    network = network if stats is None else with_statistics(network, stats, head)
    return F.get(score_mlp_policy(spark, network, F.concat(state, action), head), F.lit(0))
