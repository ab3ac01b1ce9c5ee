"""What the operators need from a running session."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut as cut
from ..session import shared_folder
from ..session import ship as ship_package

BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each Spark context.

    Rows are whole texts, so Arrow batches of Spark's usual 10,000 rows would be
    tens of megabytes, several times over; unless the session says otherwise,
    they get BATCH_ROWS rows.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))
    ship_package(spark)


def beside(docs: DataFrame, needed: tuple[str, ...], added: tuple[str, ...], use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """use(docs) with the columns of docs in their order, then those of added.

    use sees columns other than needed under other names, so no name of theirs
    can clash with one of its own. A column of docs that has the name of an
    added one, in whatever case, gives way to it.
    """
    aside = {c: f"_own{i}" for i, c in enumerate(docs.columns) if c not in needed}
    new = {a.lower() for a in added}
    own = [F.col(aside.get(c, c)).alias(c) for c in docs.columns if c.lower() not in new]
    inside = docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(aside.get(c, c)) for c in docs.columns])
    return use(inside).select(*own, *added)


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, without lineage; smaller on disk than what cut() writes."""
    place = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for the row; a lambda's body would else compute it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def anew(df: DataFrame, key: str) -> DataFrame:
    """df, with a key (string or binary) that Spark does not know to be dealt out already.

    Only a join of which both sides are shuffled for it can have the rows of
    one key split among tasks, and a third of all rows may share a key.
    """
    return df.withColumn(key, F.substring(key, 1, 2**31 - 1))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
