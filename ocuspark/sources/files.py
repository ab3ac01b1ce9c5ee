"""Samples, recordings, target configurations and weights in files."""

from __future__ import annotations

import json
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import split_label
from ..operators.samples import head, sample_schema

FORMATS = ("json", "parquet", "orc")


def check_not_empty(spark: SparkSession, path: str) -> None:
    """A file, or a folder with something in it; else ValueError. Any file system that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    if not fs.exists(place) or (fs.getFileStatus(place).isDirectory() and not len(fs.listStatus(place))):
        raise ValueError(f"nothing at {path}")


def save_samples(samples: DataFrame, path: str, fmt: str = "json", as_single_file: bool = False, n_samples: int = -1) -> None:
    """All samples, or the first n_samples by pos; as one file, or as a folder for each sample (pos=0, pos=1, …)."""
    if fmt not in FORMATS:
        raise ValueError(f"{fmt} is none of {', '.join(FORMATS)}")
    chosen = head(samples, n_samples)
    writer = chosen.coalesce(1).write if as_single_file else chosen.repartition("pos").write.partitionBy("pos")
    writer.format(fmt).save(path)


def load_samples(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType | None = None, n_samples: int = -1) -> DataFrame:
    """Samples in order of pos, as save_samples() wrote them."""
    check_not_empty(spark, path)
    schema = schema or sample_schema()
    if "pos" not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField("pos", T.LongType())])
    found = spark.read.schema(schema).format(fmt).load(path)
    return head(found, n_samples).orderBy("pos")


def load_numbered(spark: SparkSession, path: str, schema: T.StructType, n_samples: int = -1) -> DataFrame:
    """Samples of a folder with a JSON file for each, named by its number (0.json, 1.json, …), in order of these; a name without a number is an error."""
    check_not_empty(spark, path)
    found = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]*)\.json$", 1)
    pos = F.when(stem.rlike("^[0-9]+$"), stem.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("no number: "), stem)).cast("bigint"))
    return head(found.withColumn("pos", pos), n_samples).orderBy("pos")


def read_recordings_csv(spark: SparkSession, path: str, schema: T.StructType, target_column: str, **options: str) -> DataFrame:
    """Rows of CSV files with a header; rows without a label go, `class:subtype` labels are split."""
    check_not_empty(spark, path)
    raw = spark.read.schema(schema).options(header="true", **options).csv(path)
    return raw.where(F.col(target_column).isNotNull() & (F.trim(target_column) != "")).withColumn("target", split_label(F.col(target_column)))


TARGETS = "map<string,struct<skip:boolean,dataset_type:string>>"


def targets_to_json(config: DataFrame) -> str:
    """A configuration (name, skip, dataset_type, pos), a row for each target, as a JSON object in order of pos."""
    rows = config.orderBy("pos").collect()
    return json.dumps({r["name"]: {"skip": r["skip"], "dataset_type": r["dataset_type"]} for r in rows}, ensure_ascii=False, indent=4)


def save_targets(config: DataFrame, path: str) -> None:
    """targets_to_json() as one text file in the folder path, on any file system that Spark writes."""
    config.sparkSession.createDataFrame([(targets_to_json(config),)], "value string").coalesce(1).write.text(path)


def load_targets(spark: SparkSession, path: str) -> DataFrame:
    """pos, name, skip and dataset_type of each target, in the order of the file."""
    check_not_empty(spark, path)
    text = spark.read.text(path, wholetext=True)
    fields = F.from_json("value", TARGETS)
    return text.select(F.posexplode(F.map_entries(fields)).alias("pos", "e")).select(F.col("pos").cast("bigint").alias("pos"), F.col("e.key").alias("name"), "e.value.skip", "e.value.dataset_type")


def save_weights(spark: SparkSession, weights: Mapping[str, np.ndarray], path: str) -> None:
    """Weights of a network as rows (layer, shape, values)."""
    rows = [(k, list(map(int, v.shape)), v.ravel().astype(float).tolist()) for k, v in weights.items()]
    spark.createDataFrame(rows, "layer string, shape array<int>, `values` array<double>").coalesce(1).write.parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["layer"]: np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


def save_state(spark: SparkSession, arrays: Mapping[str, np.ndarray], notes: str, path: str) -> None:
    """Arrays and a text as rows (name, shape, values, text); in place of what is there."""
    rows = [(k, list(map(int, v.shape)), v.ravel().astype(float).tolist(), None) for k, v in arrays.items()]
    spark.createDataFrame([*rows, ("", None, None, notes)], "name string, shape array<int>, `values` array<double>, text string").coalesce(1).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], str]:
    rows = spark.read.parquet(path).collect()
    arrays = {r["name"]: np.array(r["values"], dtype=np.float64).reshape(r["shape"]) for r in rows if r["text"] is None}
    return arrays, next(r["text"] for r in rows if r["text"] is not None)


def whole_folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the folders below path that begin so and that a writer has finished."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(conf)
    found = fs.listStatus(top) if fs.exists(top) else []
    names = [f.getPath().getName() for f in found if f.isDirectory() and f.getPath().getName().startswith(prefix)]
    return sorted(n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
