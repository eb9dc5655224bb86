"""Schemas of the tables the operators read and write."""

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())

EPISODE = T.StructType([
    T.StructField("episode_id", T.LongType()),
    T.StructField("segment", T.LongType()),
    T.StructField("observations", T.ArrayType(VECTOR)),
    T.StructField("actions", T.ArrayType(VECTOR)),
    T.StructField("rewards", VECTOR),
])

SFT = T.StructType([
    T.StructField("observation", T.StringType()),
    T.StructField("action", T.StringType()),
])

METRIC = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("value", T.DoubleType()),
])

LAYER = T.StructType([
    T.StructField("head", T.StringType()),
    T.StructField("layer", T.IntegerType()),
    T.StructField("w", T.ArrayType(VECTOR)),
    T.StructField("b", VECTOR),
    T.StructField("activation", T.StringType()),
])

ENV_SPEC = T.StructType([
    T.StructField("env", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("obs_dim", T.IntegerType()),
    T.StructField("obs_desc", T.ArrayType(T.StringType())),
    T.StructField("action_dim", T.IntegerType()),
    T.StructField("action_desc", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("reward", T.StringType()),
    T.StructField("frequency", T.StringType()),
])
