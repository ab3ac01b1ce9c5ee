"""Neural layers over long rows: matrix products are joins and sums, so any weight table works.

Weights are small tables (out, in, w); what is scored is of any size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import shuffled, sigmoid


def linear(x: DataFrame, weights: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """x (id, j, v) times weights (o, j, w), plus bias (o, b): rows id, o, v."""
    out = x.join(weights, "j").groupBy("id", "o").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return out if bias is None else out.join(bias, "o").select("id", "o", (F.col("v") + F.col("b")).alias("v"))


def body(x: DataFrame, weights: DataFrame, bias: DataFrame | None, input_size: int, hidden_size: int) -> DataFrame:
    """The simplest body: x (id, j, v) as it is where both sizes are equal, else through one linear layer: rows id, o, v."""
    return x.select("id", F.col("j").alias("o"), "v") if input_size == hidden_size else linear(x, weights, bias)


def _uniform(seed: int, *parts: str) -> Column:
    """In (0, 1), from an MD5 of the seed and the parts, the same in every run and in SQL."""
    return (F.conv(F.substring(shuffled(seed, *[F.col(p) for p in parts]), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def initial_weights(spark: SparkSession, outs: int, ins: int, kind: str = "linear", seed: int = 0) -> DataFrame:
    """o, j, w to start from: linear (Glorot-uniform) or embedding (standard normal)."""
    places = spark.range(outs * ins).select(F.floor(F.col("id") / ins).cast("int").alias("o"), (F.col("id") % ins).cast("int").alias("j"))
    if kind == "linear":
        return places.withColumn("w", (_uniform(seed, "o", "j") * 2 - 1) * math.sqrt(6 / (outs + ins)))
    if kind == "embedding":
        return places.withColumn("w", F.sqrt(-2 * F.ln(_uniform(seed, "o", "j"))) * F.cos(2 * math.pi * _uniform(seed + 1, "o", "j")))
    raise ValueError(f"{kind} is neither linear nor embedding")


def initial_layer_norm(spark: SparkSession, size: int) -> DataFrame:
    """o, gain of 1 and bias of 0 of a layer norm."""
    return spark.range(size).select(F.col("id").cast("int").alias("o"), F.lit(1.0).alias("gain"), F.lit(0.0).alias("b"))


def relu(x: DataFrame) -> DataFrame:
    return x.withColumn("v", F.greatest("v", F.lit(0.0)))


def softmax(logits: DataFrame) -> DataFrame:
    w = Window.partitionBy("id")
    e = F.exp(F.col("v") - F.max("v").over(w))
    return logits.withColumn("p", e / F.sum(e).over(w))


def classify(probs: DataFrame) -> DataFrame:
    """id, predicted (least o of the largest p) and p."""
    return probs.groupBy("id").agg(F.max(F.struct("p", (-F.col("o")).alias("o"))).alias("m")).select("id", (-F.col("m.o")).alias("predicted"), F.col("m.p").alias("p"))


def cross_entropy(probs: DataFrame, truth: DataFrame, smoothing: float = 0.0, class_weights: DataFrame | None = None) -> DataFrame:
    """Mean loss of probs (id, o, p) against truth (id, label), smoothed over the classes; weighted by class if asked."""
    joined = probs.join(truth, "id").withColumn("k", F.count("*").over(Window.partitionBy("id")))
    target = F.when(F.col("o") == F.col("label"), 1 - smoothing).otherwise(F.lit(0.0)) + smoothing / F.col("k")
    if class_weights is None:
        per = joined.groupBy("id").agg(F.sum(-target * F.ln("p")).alias("loss"))
        return per.agg(F.avg("loss").alias("loss"))
    weighted = joined.join(class_weights.select("o", F.col("w").alias("cw")), "o")
    own = F.sum(F.when(F.col("o") == F.col("label"), F.col("cw")).otherwise(0.0))
    per = weighted.groupBy("id").agg(F.sum(-target * F.col("cw") * F.ln("p")).alias("loss"), own.alias("cw"))
    return per.agg((F.sum("loss") / F.sum("cw")).alias("loss"))


def binary_cross_entropy(scored: DataFrame) -> DataFrame:
    """Mean loss of logits (v) against labels 0 and 1 (y)."""
    return scored.agg(F.avg(F.greatest("v", F.lit(0.0)) - F.col("v") * F.col("y") + F.ln(1 + F.exp(-F.abs("v")))).alias("loss"))


def conv1d(x: DataFrame, weights: DataFrame, kernel: int, stride: int = 1, padding: int = 0) -> DataFrame:
    """x (id, c, t, v) with weights (o, c, k, w): rows id, o, t, v. Each place meets only the outputs that it is in."""
    n = F.max("t").over(Window.partitionBy("id")) + 1
    taps = x.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(kernel - 1))))
    start = F.col("t") + padding - F.col("k")
    last = F.floor((F.col("n") + 2 * padding - kernel) / stride)
    placed = taps.withColumn("s", start).where((F.col("s") >= 0) & (F.col("s") % stride == 0)).withColumn("out", F.col("s") / stride).where(F.col("out") <= last)
    return placed.join(weights, ["c", "k"]).groupBy("id", "o", F.col("out").cast("bigint").alias("t")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def batch_norm(x: DataFrame, stats: DataFrame, eps: float = 1e-5) -> DataFrame:
    """Inference form: stats (c, mean, var, gamma, beta)."""
    return x.join(stats, "c").withColumn("v", (F.col("v") - F.col("mean")) / F.sqrt(F.col("var") + eps) * F.col("gamma") + F.col("beta")).select(*x.columns)


def max_pool(x: DataFrame, size: int, stride: int | None = None) -> DataFrame:
    stride = stride or size
    n = F.max("t").over(Window.partitionBy("id")) + 1
    last = F.least(F.floor(F.col("t") / stride), F.floor((F.col("n") - size) / stride))
    first = F.greatest(F.ceil((F.col("t") - size + 1) / stride), F.lit(0))
    homes = F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint")))
    return x.withColumn("n", n).withColumn("home", F.explode(homes)).groupBy("id", "c", F.col("home").alias("t")).agg(F.max("v").alias("v"))


POOLS = ("avg", "max", "lp", "lse")


def pool_over_time(x: DataFrame, kinds: tuple[str, ...] = POOLS) -> DataFrame:
    """x (id, c, t, v): a column for each kind of pooling, rows id, c."""
    top = F.max("v").over(Window.partitionBy("id", "c"))
    of = {"avg": F.avg("v"), "max": F.max("v"), "lp": F.sqrt(F.sum(F.col("v") * F.col("v"))), "lse": F.first("top") + F.ln(F.sum(F.exp(F.col("v") - F.col("top"))))}
    return x.withColumn("top", top).groupBy("id", "c").agg(*[of[k].alias(k) for k in kinds])


def channel_gate(x: DataFrame, w1: DataFrame, w2: DataFrame, kinds: tuple[str, ...] = ("avg", "max"), biases: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Scale of each channel: sigmoid of the sum, over kinds of pooling, of a two-layer network; x scaled by it.

    w1 (o, j, w), w2 (o, j, w), and biases (o, b) of both if there are any: the same for all kinds.
    """
    b1, b2 = biases or (None, None)
    pooled = pool_over_time(x, kinds)
    total = None
    for kind in kinds:
        hidden = relu(linear(pooled.select("id", F.col("c").alias("j"), F.col(kind).alias("v")), w1, b1))
        out = linear(hidden.withColumnRenamed("o", "j"), w2, b2)
        total = out if total is None else total.unionByName(out)
    gate = total.groupBy("id", F.col("o").alias("c")).agg(F.sum("v").alias("g")).select("id", "c", sigmoid(F.col("g")).alias("gate"))
    return x.join(gate, ["id", "c"]).select("id", "c", "t", (F.col("v") * F.col("gate")).alias("v"))


def channel_pool(x: DataFrame) -> DataFrame:
    """Largest and mean value over the channels of each place, as channels 0 and 1."""
    both = x.groupBy("id", "t").agg(F.max("v").alias("m"), F.avg("v").alias("a"))
    return both.select("id", "t", F.posexplode(F.array("m", "a")).alias("c", "v")).select("id", "c", "t", "v")


def spatial_gate(x: DataFrame, weights: DataFrame, kernel: int) -> DataFrame:
    """x scaled at each place by the sigmoid of a padded convolution (o = 0) of channel_pool()."""
    gate = conv1d(channel_pool(x), weights, kernel, padding=kernel // 2).select("id", "t", sigmoid(F.col("v")).alias("gate"))
    return x.join(gate, ["id", "t"]).select("id", "c", "t", (F.col("v") * F.col("gate")).alias("v"))


def cbam(x: DataFrame, w1: DataFrame, w2: DataFrame, spatial: DataFrame | None = None, kernel: int = 7, biases: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    gated = channel_gate(x, w1, w2, biases=biases)
    return gated if spatial is None else spatial_gate(gated, spatial, kernel)
