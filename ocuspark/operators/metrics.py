"""Verification metrics. Scores are grouped first; prefix sums run over distinct scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..session import cut


def fmr_fnmr(scores: DataFrame, partitions: int = 64) -> DataFrame:
    """threshold, fmr and fnmr at each distinct score, from scores (score, genuine, and n if a row stands for several).

    fnmr: share of genuine scores below the threshold; fmr: share of impostor
    scores not below it. Null if there are none of a kind. Sums run in two
    levels: inside ranges of scores, and over the ranges' totals.
    """
    times = F.col("n") if "n" in scores.columns else F.lit(1).cast("bigint")
    by_score = scores.where("score is not null").groupBy(F.col("score").alias("threshold")).agg(
        F.sum(F.when(F.col("genuine"), times).otherwise(0)).alias("g"), F.sum(F.when(~F.col("genuine"), times).otherwise(0)).alias("m")
    )
    parted = cut(by_score.repartitionByRange(partitions, "threshold").withColumn("part", F.spark_partition_id()))
    totals = parted.groupBy("part").agg(F.sum("g").alias("tg"), F.sum("m").alias("tm"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part", F.coalesce(F.sum("tg").over(before), F.lit(0)).alias("og"), F.coalesce(F.sum("tm").over(before), F.lit(0)).alias("om"),
        F.sum("tg").over(Window.partitionBy()).alias("all_g"), F.sum("tm").over(Window.partitionBy()).alias("all_m"),
    )
    inside = Window.partitionBy("part").orderBy("threshold").rowsBetween(Window.unboundedPreceding, -1)
    summed = parted.withColumns({"bg": F.coalesce(F.sum("g").over(inside), F.lit(0)), "bm": F.coalesce(F.sum("m").over(inside), F.lit(0))}).join(offsets, "part")
    return summed.select(
        "threshold",
        ratio((F.col("all_m") - F.col("om") - F.col("bm")).cast("double"), F.col("all_m").cast("double")).alias("fmr"),
        ratio((F.col("og") + F.col("bg")).cast("double"), F.col("all_g").cast("double")).alias("fnmr"),
    )


def eer(curves: DataFrame) -> DataFrame:
    """idx, low, high and eer where the curves cross: one row; (0, 1, 1, 1) if they never do.

    The first threshold with fmr <= fnmr, or the one before it if the sum of
    both is not larger there. Thresholds are compared and counted, not numbered,
    so no task sees all of them in order.
    """
    point = F.struct("threshold", "fmr", "fnmr")
    first = curves.where("fmr <= fnmr").agg(F.min(point).alias("c")).withColumn("k", F.lit(0))
    ahead = F.col("threshold") < F.col("c.threshold")
    found = curves.withColumn("k", F.lit(0)).join(F.broadcast(first), "k").agg(F.first("c").alias("c"), F.max(F.when(ahead, point)).alias("b"), F.count_if(ahead).alias("n"))
    total = lambda p: F.col(f"{p}.fmr") + F.col(f"{p}.fnmr")
    earlier = F.col("b").isNotNull() & (F.col("c.fmr") != F.col("c.fnmr")) & (total("b") <= total("c"))
    best = found.select(F.when(earlier, F.col("b")).otherwise(F.col("c")).alias("p"), (F.col("n") - F.when(earlier, 1).otherwise(0)).alias("at"))
    return best.select(
        F.when(F.col("p").isNull(), F.lit(0)).otherwise(F.col("at")).cast("bigint").alias("idx"),
        F.coalesce(F.least("p.fmr", "p.fnmr"), F.lit(1.0)).alias("low"),
        F.coalesce(F.greatest("p.fmr", "p.fnmr"), F.lit(1.0)).alias("high"),
        F.coalesce(total("p") / 2, F.lit(1.0)).alias("eer"),
    )


def accuracy(predicted: DataFrame, label: str, guess: str) -> DataFrame:
    return predicted.agg(F.avg((F.col(label) == F.col(guess)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def first_places(values: DataFrame, value: str, place: str) -> DataFrame:
    """Distinct values with their first place."""
    return values.groupBy(value).agg(F.min(place).alias("first_place"))


METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "accuracy": lambda p: p.agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("value")),
    "error_rate": lambda p: p.agg(F.avg((F.col("label") != F.col("predicted")).cast("double")).alias("value")),
    "mean_probability": lambda p: p.agg(F.avg("probability").alias("value")),
    "eer": lambda p: eer(fmr_fnmr(p.select(F.col("probability").alias("score"), (F.col("label") == F.col("predicted")).alias("genuine")))).select(F.col("eer").alias("value")),
}


def compute(predicted: DataFrame, names: Sequence[str]) -> DataFrame:
    """metric and value: the named metrics of predictions (label, predicted, probability), in the order of names.

    eer: a prediction's probability as the score of its own claim.
    """
    if unknown := [n for n in names if n not in METRICS]:
        raise ValueError(f"{unknown} are none of {', '.join(METRICS)}")
    rows = [METRICS[n](predicted).select(F.lit(n).alias("metric"), "value") for n in names]
    return reduce(DataFrame.unionByName, rows)
