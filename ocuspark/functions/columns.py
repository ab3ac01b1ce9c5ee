"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def clip(x: Column, low: float, high: float) -> Column:
    """x held within [low, high]; null and NaN stay as they are."""
    if low > high:
        raise ValueError(f"bounds {low} > {high}")
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.greatest(F.lit(float(low)), F.least(x, F.lit(float(high)))))


def shuffled(seed: int, *parts: Column) -> Column:
    """A deterministic stand-in for a random number: rows are shuffled by ordering on it."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two arrays of the same size; an error otherwise."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.sqrt(squares)).otherwise(F.raise_error(F.lit("vectors differ in size")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def one_hot(idx: Column, n: int) -> Column:
    """Array of n zeros with a one at idx; all zeros for null."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce((k == idx).cast("int"), F.lit(0)))


def split_label(text: Column) -> Column:
    """`class:subtype` as a struct; subtype is null without a colon."""
    return F.struct(F.split(text, ":")[0].alias("name"), F.get(F.split(text, ":", 2), F.lit(1)).alias("subtype"))


def smooth_l1(predicted: Column, true: Column) -> Column:
    gap = F.abs(predicted - true)
    return F.when(gap < 1, gap * gap / 2).otherwise(gap - 0.5)


def merge_labels(a: Column, b: Column) -> Column:
    """Two predictions (labels, probabilities, distances) as one.

    Probabilities are merged by class, b's win; distances add up, null if their
    sizes differ; labels are joined, the first of each name stays.
    """
    names = F.concat(a["labels"], b["labels"])
    distances = F.when(F.size(a["distances"]) == F.size(b["distances"]), F.zip_with(a["distances"], b["distances"], lambda x, y: x + y))
    merged = F.map_zip_with(a["probabilities"], b["probabilities"], lambda k, x, y: F.coalesce(y, x))
    return F.struct(F.array_distinct(names).alias("labels"), merged.alias("probabilities"), distances.alias("distances"))
