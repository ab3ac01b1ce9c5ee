"""Whole-sample operators: identity, union, update, narrow types."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTITY = ("guid", "seq_id", "session_id", "user_id", "data_type")

def sample_schema() -> T.StructType:
    """Columns of a sample; needs a running session."""
    return T.StructType.fromDDL(
        "guid bigint, seq_id bigint, session_id bigint, user_id bigint, label_id int, label_name string, data array<array<double>>, data_type string, "
        "dataset_type string, stimulus_type string, stimulus_file string, stimulus_data array<double>, skip_sample boolean, attributes map<string,string>"
    )


def not_empty(samples: DataFrame) -> DataFrame:
    """The samples; an error if there are none."""
    if samples.isEmpty():
        raise ValueError("a set of samples must not be empty")
    return samples


def check_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """df; TypeError if a column of expected is missing or of another type. Other columns and nullability don't matter."""
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = [f"{f.name}: {found.get(f.name, 'missing')}, not {f.dataType.simpleString()}" for f in expected.fields if found.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise TypeError("; ".join(wrong))
    return df


def update(samples: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Columns that there are get new values; others are ignored."""
    return samples.withColumns({k: v for k, v in values.items() if k in samples.columns})


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both, repeats and all."""
    return a.unionByName(b)


def distinct_by_identity(samples: DataFrame, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    return samples.dropDuplicates(list(identity))


def head(samples: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """The first n; all for -1."""
    return samples if n == -1 else samples.orderBy(order).limit(n)


def to_text(samples: DataFrame, columns: list[str]) -> DataFrame:
    """Scalar fields of each sample as JSON; nulls and arrays are left out."""
    plain = [c for c in columns if not isinstance(samples.schema[c].dataType, (T.ArrayType, T.MapType))]
    return samples.select(F.to_json(F.struct(*plain)).alias("text"))


def from_text(texts: DataFrame, schema: T.StructType) -> DataFrame:
    return texts.select(F.from_json("text", schema).alias("s")).select("s.*")


def narrow_types(df: DataFrame) -> dict[str, str]:
    """For each number column, the smallest type whose range holds its least and largest value, strictly inside."""
    integers = (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63))
    columns = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    row = df.agg(*[f(c.name).alias(f"{n}_{c.name}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for c in columns:
        lo, hi = row[f"lo_{c.name}"], row[f"hi_{c.name}"]
        if lo is None:
            out[c.name] = c.dataType.simpleString()
        elif isinstance(c.dataType, T.IntegralType):
            out[c.name] = next((t for t, b in integers if -(2**b) < lo and hi < 2**b - 1), "bigint")
        else:
            out[c.name] = "float" if max(abs(lo), abs(hi)) < 3.4e38 else "double"
    return out


def narrow(df: DataFrame) -> DataFrame:
    """Number columns cast to narrow_types(); others as they are."""
    types = narrow_types(df)
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def categories(df: DataFrame, column: str) -> DataFrame:
    """column and code: the distinct texts of a column, numbered from 0 in their order; null has no code. A dimension table."""
    texts = df.where(F.col(column).isNotNull()).select(column).distinct()
    return texts.withColumn("code", (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))


def categorize(df: DataFrame, column: str) -> DataFrame:
    """df with the codes of categories() in place of the texts of a column."""
    coded = df.join(categories(df, column), column, "left").withColumn(column, F.col("code"))
    return coded.select(*df.columns)
