"""Places of rows in an order over a whole table, without a task that sees all of them; and medians without buffers of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

PARTS = 64


def ranked(df: DataFrame, order: Sequence[Column | str], parts: int = PARTS) -> DataFrame:
    """df with rank (from 0) in that order, and n (all rows).

    Rows are dealt out by ranges of the order and numbered inside each; a range
    starts at the sum of the counts of those before it, one number a range.
    Rows of equal order are in one range and are numbered in any order.
    """
    placed = df.repartitionByRange(parts, *[F.col(c) if isinstance(c, str) else c for c in order]).withColumn("_range", F.spark_partition_id())
    written = cut(placed)  # ranges come from samples: they must be the same when a task runs again
    counts = {r["_range"]: r["count"] for r in written.groupBy("_range").count().collect()}  # parts rows at most
    before, total = [0] * (parts + 1), sum(counts.values())
    for k in range(parts):
        before[k + 1] = before[k] + counts.get(k, 0)
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    start = F.get(F.array(*[F.lit(b).cast("bigint") for b in before]), F.col("_range"))
    return written.withColumns({"rank": start + inside, "n": F.lit(total).cast("bigint")}).drop("_range")


BINS, FEW = 256, 10_000


def medians(df: DataFrame, by: Sequence[str], value: str, few: int = FEW, bins: int = BINS) -> DataFrame:
    """by and median (the mean of both middle values of an even number) of each group; null where it has no values. Exact.

    Each round counts the values of all groups in bins between their bounds and
    keeps the bins with the middle values, until a group has at most `few` left
    or they are all equal. Only these are sorted in one place. Bins are of equal width,
    so values whose sizes differ by powers take a round for each `bins`-fold.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = cut(df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")))
    same = lambda a, b: [a[k].eqNullSafe(b[f"{k}_"]) for k in keys]
    aside = lambda g: g.select(*[F.col(k).alias(f"{k}_") for k in keys], *[c for c in g.columns if c not in keys])
    # low and high: bounds of what is left of a group; first and last: places of the middle values in it
    groups = cut(rows.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).withColumns({"first": F.floor((F.col("n") - 1) / 2), "last": F.floor(F.col("n") / 2)}))
    done: list[DataFrame] = []
    while True:
        open_ = groups.where((F.col("n") > few) & (F.col("low") < F.col("high")))
        done.append(groups.where((F.col("n") <= few) | (F.col("low") >= F.col("high"))))
        if open_.isEmpty():
            break
        g = aside(open_)
        inside = rows.join(g, same(rows, g)).where(F.col("v").between(F.col("low"), F.col("high")))
        at = F.least(F.lit(bins - 1), F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bins))
        each = inside.withColumn("bin", at).groupBy(*keys, "bin", "first", "last").agg(F.count("*").alias("k"), F.min("v").alias("least"), F.max("v").alias("most"))
        order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = each.withColumn("before", F.coalesce(F.sum("k").over(order), F.lit(0)))
        middle = placed.where((F.col("before") <= F.col("last")) & (F.col("before") + F.col("k") > F.col("first")))
        merged = middle.groupBy(*keys, "first", "last").agg(F.min("least").alias("low"), F.max("most").alias("high"), F.sum("k").alias("n"), F.min("before").alias("before"))
        groups = cut(merged.withColumns({"first": F.col("first") - F.col("before"), "last": F.col("last") - F.col("before")}).select(*keys, "low", "high", "n", "first", "last"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    g = aside(found)
    short = rows.join(g, same(rows, g)).where((F.col("low") < F.col("high")) & F.col("v").between(F.col("low"), F.col("high")))
    sorted_ = short.groupBy(*keys, "first", "last").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    value_at = lambda c: F.get("vs", F.col(c).cast("int"))
    result = sorted_.select(*keys, ((value_at("first") + value_at("last")) / 2).alias("median")).unionByName(found.where(F.col("low") >= F.col("high")).select(*keys, F.col("low").alias("median")))
    every = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).distinct()
    r = aside(result)
    return every.join(r, same(every, r), "left").select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], "median")
