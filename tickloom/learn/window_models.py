"""Models on sequence windows: fitted, stored as versioned tables of weights, loaded elsewhere and applied to whole windows.

A model is a stack of dense layers over the flattened window (row by row, features in order). The stored form is one row per unit
of a layer, so any process that can write such rows can hand over a network; a linear fit is one layer of one unit. Scoring
multiplies a batch of windows with the weight matrices at once. What the driver and a task hold of a model is its weights, which do not grow
with the data; a model above `MOST_WEIGHTS` is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators.clean import clean_sequences
from ..plans.registry import Registry
from .gram import fits, products

STORED = ("model_name string, version string, created timestamp_ntz, length int, features array<string>, layer int, activation string, "
          "unit int, bias double, weights array<double>")
ACTIVATIONS = ("linear", "logistic", "tanh", "relu")
MOST_WEIGHTS = 1 << 24


@dataclass(frozen=True)
class Layer:
    """units x inputs weights, one bias per unit."""

    weights: np.ndarray
    bias: np.ndarray
    activation: str = "linear"


@dataclass(frozen=True)
class WindowModel:
    name: str
    features: tuple[str, ...]
    length: int
    layers: tuple[Layer, ...]
    version: str = ""

    def check(self) -> "WindowModel":
        width = self.length * len(self.features)
        for layer in self.layers:
            if layer.activation not in ACTIVATIONS:
                raise ValueError(f"unknown activation {layer.activation}")
            if layer.weights.shape != (len(layer.bias), width):
                raise ValueError(f"a layer of {layer.weights.shape} weights and {len(layer.bias)} biases after {width} values")
            width = len(layer.bias)
        if width != 1:
            raise ValueError(f"the last layer has {width} units, a score is one")
        if sum(layer.weights.size for layer in self.layers) > MOST_WEIGHTS:
            raise ValueError(f"more than {MOST_WEIGHTS} weights")
        return self


def landing_windows(df: DataFrame, features, length: int, keep=(), fill: bool = True) -> DataFrame:
    """symbol, ts, pos, the kept columns and `window`: the features of the `length` rows before each row, NULL on earlier rows."""
    features = list(features)
    if fill:
        df = clean_sequences(df, features)
    reg = Registry()

    def before(f):
        cells = F.array(*[f[c].cast("double") for c in features])
        return F.when(f["pos"] >= length, f.window_list(cells, -length, -1))

    reg.add("window", window=before)
    return reg.compute(df, ["window"], keep=keep)


def fit_window_model(windows: DataFrame, features, length: int, target: str, name: str = "window_model") -> WindowModel:
    """Least squares of a target column on the flattened windows, from one pass of sums over the rows that have both."""
    features = tuple(features)
    width = length * len(features)
    known = windows.where(F.col("window").isNotNull() & F.col(target).isNotNull())
    cells = products(known, F.concat(F.flatten("window"), F.array(F.col(target).cast("double"))))
    rows = fits(cells, list(range(1, width + 1)), width + 1, by=()).collect()  # one row: the weights
    if not rows:
        raise ValueError("no window with a target")
    layer = Layer(np.array([rows[0].weights]), np.array([rows[0].intercept]))
    return WindowModel(name, features, length, (layer,)).check()


def save_model(spark: SparkSession, model: WindowModel, path: str, version: str) -> None:
    """Add a version of a model to a table of weights, one row per unit, in a folder of its own: other versions are not touched."""
    model.check()
    rows = [(k, layer.activation, u, float(layer.bias[u]), layer.weights[u].tolist()) for k, layer in enumerate(model.layers) for u in range(len(layer.bias))]
    table = spark.createDataFrame(rows, "layer int, activation string, unit int, bias double, weights array<double>")
    table = table.select(
        F.lit(model.name).alias("model_name"), F.lit(version).alias("version"), F.current_timestamp().cast("timestamp_ntz").alias("created"),
        F.lit(model.length).alias("length"), F.array(*[F.lit(c) for c in model.features]).alias("features"), "layer", "activation", "unit", "bias", "weights")
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_name", "version").parquet(path)


def model_versions(spark: SparkSession, path: str) -> DataFrame:
    """model_name, version, created, units and weights of every stored version."""
    return spark.read.schema(STORED).parquet(path).groupBy("model_name", "version").agg(
        F.max("created").alias("created"), F.count(F.lit(1)).alias("units"), F.sum(F.size("weights")).alias("weights"))


def load_model(spark: SparkSession, path: str, name: str, version: str | None = None) -> WindowModel:
    """A stored version, the newest unless one is named. Only its folder is read."""
    table = spark.read.schema(STORED).parquet(path).where(F.col("model_name") == name)
    if version is None:
        newest = table.agg(F.max(F.struct("created", "version")).alias("v")).first().v
        version = newest.version if newest else None
    table = table.where(F.col("version") == version)
    size = table.agg(F.sum(F.size("weights"))).first()[0]
    if size is None:
        raise ValueError(f"no version {version} of {name}")
    if size > MOST_WEIGHTS:
        raise ValueError(f"{name} has more than {MOST_WEIGHTS} weights")
    rows = table.orderBy("layer", "unit").collect()
    layers = []
    for k in sorted({r.layer for r in rows}):
        units = [r for r in rows if r.layer == k]
        layers.append(Layer(np.array([r.weights for r in units]), np.array([r.bias for r in units]), units[0].activation))
    return WindowModel(name, tuple(rows[0].features), rows[0].length, tuple(layers), version).check()


def score_windows(windows: DataFrame, model: WindowModel, column: str = "score", none: float | None = None) -> DataFrame:
    """The model's output for each window; `none` where there is no window or it holds a NULL."""
    model.check()
    layers = [(layer.weights.T, layer.bias, layer.activation) for layer in model.layers]
    width, at = model.length * len(model.features), len(windows.columns)
    flat = windows.select("*", F.flatten("window").alias("_flat"))
    usable = F.col("_flat").isNotNull() & (F.size("_flat") == width) & ~F.exists("_flat", lambda v: v.isNull())
    flat = flat.withColumn("_flat", F.when(usable, F.col("_flat")))
    schema = StructType([*windows.schema.fields, StructField(column, DoubleType())])
    shared = windows.sparkSession.sparkContext.broadcast(layers)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shape = {"linear": lambda z: z, "logistic": lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))), "tanh": np.tanh, "relu": lambda z: np.maximum(z, 0.0)}
        for batch in batches:
            flat = batch.column(at)
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            x = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for weights, bias, activation in shared.value:
                x = shape[activation](x @ weights + bias)
            out = np.full(batch.num_rows, np.nan if none is None else none)
            out[there] = x[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, mask=~there if none is None else None)], names=schema.names)

    return flat.mapInArrow(run, schema)


def model_scores(features: DataFrame, model: WindowModel, keep=(), column: str = "confidence", fill: bool = True) -> DataFrame:
    """The score of the window that ends just before each row; rows without a whole window before them get 0."""
    windows = landing_windows(features, model.features, model.length, keep, fill)
    return score_windows(windows, model, column, none=0.0).drop("window")
