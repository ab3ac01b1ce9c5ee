"""Class prototypes, distances to them, and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import euclidean
from ..sources import files


def prototypes(embeddings: DataFrame) -> DataFrame:
    """label and its mean vector: sums by label and place, whatever the number of vectors."""
    long = embeddings.select("label", F.posexplode("embedding").alias("pos", "v"))
    means = long.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("c"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]).alias("prototype"))


SPREAD = 32


def distances(queries: DataFrame, protos: DataFrame) -> DataFrame:
    """Every query with every prototype.

    There is a prototype for each label: a small table, sent whole where Spark
    finds it small. Else each of SPREAD parts of the queries meets a copy of it.
    """
    left = queries.withColumn("k", F.pmod(F.xxhash64("embedding"), F.lit(SPREAD)).cast("int"))
    right = protos.select(F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("k"), F.col("label").alias("proto_label"), "prototype")
    return left.join(right, "k").withColumn("distance", euclidean(F.col("embedding"), F.col("prototype"))).drop("k", "prototype")


def probabilities(measured: DataFrame, key: str = "vec_id") -> DataFrame:
    """distances() with the softmax of minus distance over the labels."""
    w = Window.partitionBy(key)
    return measured.withColumn("probability", F.exp(-F.col("distance")) / F.sum(F.exp(-F.col("distance"))).over(w))


def predict(measured: DataFrame, key: str = "vec_id") -> DataFrame:
    """The nearest label and its probability for each query; ties go to the smallest label."""
    best = F.row_number().over(Window.partitionBy(key).orderBy("distance", "proto_label"))
    return probabilities(measured, key).withColumn("best", best).where("best = 1").drop("best").withColumnRenamed("proto_label", "predicted")


def confident(predicted: DataFrame, level: float) -> DataFrame:
    return predicted.where(F.col("probability") >= level)


def support_and_query(embeddings: DataFrame, n_support: int, key: str = "vec_id") -> DataFrame:
    """role: the first n_support vectors of a label are support."""
    nth = F.row_number().over(Window.partitionBy("label").orderBy(key))
    return embeddings.withColumn("role", F.when(nth <= n_support, "support").otherwise("query"))


def score(embeddings: DataFrame, n_support: int, key: str = "vec_id") -> DataFrame:
    """Loss (mean negative log probability of the true label) and accuracy of queries against support prototypes."""
    roles = support_and_query(embeddings, n_support, key)
    queries, support = roles.where("role = 'query'"), roles.where("role = 'support'")
    measured = distances(queries.select(key, "label", "embedding"), prototypes(support))
    by_query = measured.groupBy(key, "label").agg(
        F.min(F.when(F.col("proto_label") == F.col("label"), F.col("distance"))).alias("own"),
        F.sum(F.exp(-F.col("distance"))).alias("total"),
        F.min(F.struct("distance", "proto_label"))["proto_label"].alias("predicted"),
    )
    return by_query.agg(F.avg(F.col("own") + F.ln("total")).alias("loss"), F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("queries"))


def attach(samples: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Samples with their prediction, by key; samples without one have null."""
    cols = [c for c in predicted.columns if c not in samples.columns]
    return samples.join(predicted.select(key, F.struct(*cols).alias("predicted_label")), key, "left")


def sums(embeddings: DataFrame) -> DataFrame:
    """label, n and the sum of its vectors: what prototypes are made of, and what can be added up. Rows with a null label, vector or value are left out."""
    good = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull()))
    return _added(good.select("label", F.lit(1).cast("bigint").alias("n"), F.col("embedding").cast("array<double>").alias("sums")))


def _added(parts: DataFrame) -> DataFrame:
    """One row a label from rows (label, n, sums), by label and place, so no vectors are gathered."""
    each = parts.select("label", "n", F.posexplode("sums").alias("pos", "v")).groupBy("label", "pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    whole = each.groupBy("label").agg(F.min("n").alias("least"), F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("at"))
    same = F.when(F.col("least") == F.col("n"), F.transform("at", lambda x: x["v"])).otherwise(F.raise_error(F.lit("vectors of one label differ in size")))
    return whole.select("label", "n", same.alias("sums"))


class Store:
    """Prototypes of known labels in files, for queries that come without support vectors.

    The state is a table of counts and sums, one version after the other; an
    update reads the last whole version, adds a batch and writes the next one,
    so a lost update leaves the state as it was. Batches in any order give the
    same sums, up to rounding. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def versions(self) -> list[str]:
        return files.whole_folders(self.spark, self.path, "version-")

    def state(self) -> DataFrame | None:
        """label, n and sums of the last version; None if nothing is stored."""
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/{found[-1]}") if found else None

    def update(self, embeddings: DataFrame) -> None:
        """Add vectors (label, embedding)."""
        new, old = sums(embeddings), self.state()
        whole = new if old is None else _added(old.unionByName(new))
        at = int(self.versions()[-1].rsplit("-", 1)[1]) + 1 if old is not None else 0
        whole.write.mode("overwrite").parquet(f"{self.path}/version-{at:09d}")

    def prototypes(self) -> DataFrame:
        """label, prototype and n."""
        state = self.state()
        if state is None:
            raise ValueError(f"no prototypes at {self.path}")
        return state.select("label", F.transform("sums", lambda v: v / F.col("n")).alias("prototype"), "n")


def chosen(support: DataFrame | None = None, store: Store | None = None) -> DataFrame:
    """label and prototype: hot ones, of support vectors, where there are some to ask; else the stored, cold ones; else ValueError."""
    if support is not None:
        return prototypes(support)
    if store is not None and store.versions():
        return store.prototypes().select("label", "prototype")
    raise ValueError("predictions need support vectors (label, embedding) or stored prototypes")


def predict_with(queries: DataFrame, support: DataFrame | None = None, store: Store | None = None, key: str = "vec_id") -> DataFrame:
    """predict() against the prototypes that chosen() gives."""
    return predict(distances(queries, chosen(support, store)), key)
