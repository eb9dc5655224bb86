"""Small networks for the scoring queries, their weights given by a rule, and the same networks in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..sources.tables import ACT_DIMS, OBS_DIMS

BOTH = OBS_DIMS + ACT_DIMS


def _weights(rows: int, columns: int, phase: float) -> tuple[list[list[float]], list[float]]:
    w = [[math.sin(phase + 3 * r + c) / 2 for c in range(columns)] for r in range(rows)]
    return w, [math.cos(phase + r) / 4 for r in range(rows)]


def _layer(head: str, layer: int, rows: int, columns: int, phase: float, activation: str):
    w, b = _weights(rows, columns, phase)
    return head, layer, w, b, activation


LINEAR_REWARD = [_layer("out", 0, 1, BOTH, 0.3, "id")]
REWARD_MODEL = [_layer("out", 0, 8, BOTH, 0.1, "relu"), _layer("out", 1, 8, 8, 0.7, "relu"),
                _layer("out", 2, 1, 8, 1.3, "id")]
POLICY = [_layer("out", 0, 8, OBS_DIMS, 0.2, "leaky_relu"), _layer("out", 1, 8, 8, 0.9, "leaky_relu"),
          _layer("out", 2, ACT_DIMS, 8, 1.7, "tanh")]
POLICY_OTHER = [_layer("out", 0, 8, OBS_DIMS, 2.2, "tanh"), _layer("out", 1, ACT_DIMS, 8, 2.9, "id")]
GAUSSIAN_POLICY = [_layer("body", 0, 8, OBS_DIMS, 0.4, "tanh"), _layer("body", 1, 8, 8, 1.1, "tanh"),
                   _layer("mean", 0, ACT_DIMS, 8, 0.5, "id"), _layer("log_std", 0, ACT_DIMS, 8, 0.8, "id")]
CATEGORICAL_POLICY = [_layer("body", 0, 8, OBS_DIMS, 0.6, "tanh"), _layer("logits", 0, 2, 8, 1.9, "id")]


def network_frame(spark: SparkSession, layers: list) -> DataFrame:
    return spark.createDataFrame(layers, schemas.LAYER)


_SQL_ACTIVATIONS = {
    "relu": "CASE WHEN {x} > 0 THEN {x} ELSE 0::DOUBLE END",
    "leaky_relu": "CASE WHEN {x} > 0 THEN {x} ELSE 0.01::DOUBLE * {x} END",
    "tanh": "tanh({x})",
    "id": "{x}",
}


def _floats(values: list[float]) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


def forward_sql(layers: list, source: str, keep: str, vector: str, out: str = "y") -> str:
    """Nested SELECTs that run the layers on a vector column of ``source``."""
    inner, current = source, vector
    for n, (_, _, w, b, activation) in enumerate(layers):
        units = "[" + ", ".join(f"{{'w': {_floats(row)}, 'b': {bias!r}::DOUBLE}}" for row, bias in zip(w, b)) + "]"
        linear = f"list_transform({units}, lambda u: list_dot_product(u.w, {current}) + u.b)"
        act = _SQL_ACTIVATIONS[activation].format(x="z")
        inner = (f"(SELECT {keep}, list_transform(z, lambda z: {act}) AS h{n} FROM "
                 f"(SELECT {keep}, {linear} AS z FROM {inner}))")
        current = f"h{n}"
    return f"(SELECT {keep}, {current} AS {out} FROM {inner})"


def normalized_sql(vector: str, mean: str, std: str) -> str:
    return (f"list_transform(list_zip({vector}, (SELECT {mean} FROM norm_stats), (SELECT {std} FROM norm_stats)), "
            "lambda p: (p[1] - p[2]) / (p[3] + 1e-8::DOUBLE))")


def linear_reward_sql(state: str, action: str) -> str:
    _, _, w, b, _ = LINEAR_REWARD[0]
    x = (f"list_concat({normalized_sql(state, 'state_mean', 'state_std')}, "
         f"{normalized_sql(action, 'action_mean', 'action_std')})")
    return (f"CASE WHEN ({action}) IS NOT NULL THEN (list_dot_product({_floats(w[0])}, {x}) + {b[0]!r}::DOUBLE) "
            "* (SELECT reward_std FROM norm_stats) + (SELECT reward_mean FROM norm_stats) END")
