"""Training of the linear head: multinomial logistic regression over embeddings, by Spark ML."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from . import layers


@dataclass
class LinearHead:
    """Weights (o, j, w) and bias (o, b) as tables for layers.linear()."""

    weights: DataFrame
    bias: DataFrame

    def logits(self, embeddings: DataFrame, key: str = "vec_id") -> DataFrame:
        x = embeddings.select(F.col(key).alias("id"), F.posexplode("embedding").alias("j", "v")).withColumn("v", F.col("v").cast("double"))
        return layers.linear(x, self.weights, self.bias)

    def predict(self, embeddings: DataFrame, key: str = "vec_id") -> DataFrame:
        """id, predicted label and its probability."""
        return layers.classify(layers.softmax(self.logits(embeddings, key)))


def fit_linear_head(embeddings: DataFrame, iterations: int = 50, decay: float = 1e-3, class_weights: DataFrame | None = None) -> LinearHead:
    """A head for labels 0 .. k-1 of (embedding, label); with class_weights (label, weight) rows count by class."""
    spark = embeddings.sparkSession
    rows = embeddings.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    model = LogisticRegression(family="multinomial", maxIter=iterations, regParam=decay)
    if class_weights is not None:
        rows = rows.join(class_weights.select(F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight")), "label")
        model = model.setWeightCol("weight")
    fitted = model.fit(rows)
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    w = spark.createDataFrame([(o, j, float(v)) for o, row in enumerate(matrix) for j, v in enumerate(row)], "o int, j int, w double")
    return LinearHead(w, spark.createDataFrame([(o, float(b)) for o, b in enumerate(bias)], "o int, b double"))


def _normal_equations(rows: DataFrame, weights: np.ndarray | None, size: int, outs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each output: the sums of w x x' and of w x y, x with a 1 at its end; w 1 where the residual of weights is below 1, else 1 over it.

    A task's batches are summed where they are, and tasks in 32 groups, so the
    driver gets 32 rows of outs * (size + 1) * (size + 2) numbers at most.
    """
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((outs, size + 1, size + 2))
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=np.float64).reshape(-1, size)
            y = np.array(batch.column("y").to_pylist(), dtype=np.float64).reshape(-1, outs)
            x = np.column_stack([x, np.ones(len(x))])
            w = np.ones_like(y) if shared.value is None else 1 / np.maximum(np.abs(y - x @ shared.value.T), 1)
            for o in range(outs):
                total[o] += (x * w[:, o : o + 1]).T @ np.column_stack([x, y[:, o]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def merge(table: pa.Table) -> pa.Table:
        # in one order, so that sums are the same when a task runs again
        return pa.table({"total": pa.array([sum(np.frombuffer(t) for t in sorted(table.column("total").to_pylist())).tobytes()], pa.binary())})

    parts = rows.select("x", "y").mapInArrow(add, "total binary").withColumn("k", F.pmod(F.xxhash64("total"), F.lit(32)))
    got = sorted(bytes(r.total) for r in parts.groupBy("k").applyInArrow(merge, "total binary").collect())
    shared.unpersist()
    total = sum(np.frombuffer(t) for t in got).reshape(outs, size + 1, size + 2)
    return total[:, :, :-1], total[:, :, -1]


def fit_regression_head(pairs: DataFrame, loss: str = "squared", decay: float = 0.0, rounds: int = 50, tolerance: float = 1e-9) -> LinearHead:
    """Head of numbers from pairs (embedding, target: an array): the least mean squared or smooth-L1 (beta 1) loss.

    Squared: one solve of the normal equations, summed in Spark. Smooth-L1: rows
    are weighted by their residual and the equations solved again, until weights
    move by less than tolerance. decay: added to the squares' diagonal, not to
    the bias. Rows with a null, or of another size than most, are an error or
    left out: nulls go, sizes must agree. No rows are an error.
    """
    if loss not in ("squared", "smooth_l1"):
        raise ValueError(f"{loss} is neither squared nor smooth_l1")
    spark = pairs.sparkSession
    ship(spark)
    good = pairs.where("embedding is not null and target is not null").select(F.col("embedding").cast("array<double>").alias("x"), F.col("target").cast("array<double>").alias("y"))
    rows = cut(good.where(~F.exists("x", lambda v: v.isNull()) & ~F.exists("y", lambda v: v.isNull())))
    sizes = rows.select(F.size("x").alias("a"), F.size("y").alias("b")).distinct().limit(2).collect()
    if len(sizes) != 1:
        raise ValueError("rows differ in size" if sizes else "no rows to fit")
    size, outs = sizes[0]
    weights = None
    ridge = decay * np.diag([1.0] * size + [0.0])
    for _ in range(1 if loss == "squared" else rounds):
        squares, products = _normal_equations(rows, weights, size, outs)
        new = np.stack([np.linalg.lstsq(a + ridge, b, rcond=None)[0] for a, b in zip(squares, products, strict=True)])
        moved = np.inf if weights is None else np.abs(new - weights).max()
        weights = new
        if moved < tolerance:
            break
    w = spark.createDataFrame([(o, j, float(v)) for o, row in enumerate(weights[:, :-1]) for j, v in enumerate(row)], "o int, j int, w double")
    return LinearHead(w, spark.createDataFrame([(o, float(b)) for o, b in enumerate(weights[:, -1])], "o int, b double"))
