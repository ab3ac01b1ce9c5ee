"""Sessions of any length: blocks of places with the places around them, so that no task needs a whole session.

Rows are numbered in two levels (inside a part, and by the parts before it), a
block's rows come with a halo of their neighbours, and what belongs to a session
as a whole (its length, its first and last values) is aggregated and joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, PLACE = "session", "i"


def check(block: int | None) -> None:
    if block is not None and block < 1:
        raise ValueError(f"a block of {block} places")


def numbered(df: DataFrame, channels: Sequence[str], block: int | None) -> DataFrame:
    """session, i, channels, _at (the row's number in its session, from 0) and _n (rows of the session)."""
    check(block)
    if block is None:
        whole = Window.partitionBy(KEY)
        return df.select(KEY, PLACE, *channels, (F.row_number().over(whole.orderBy(PLACE)) - 1).alias("_at"), F.count("*").over(whole).alias("_n"))
    parted = df.select(KEY, PLACE, *channels, F.floor(F.col(PLACE) / block).alias("_part"))
    # a row a part: its place among those of its session is found from these counts alone
    counts = parted.groupBy(KEY, "_part").agg(F.count("*").alias("_k"))
    session = Window.partitionBy(KEY)
    before = F.coalesce(F.sum("_k").over(session.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select(F.col(KEY).alias("_key"), F.col("_part").alias("_own"), before.alias("_before"), F.sum("_k").over(session).alias("_n"))
    met = parted.join(places, F.col(KEY).eqNullSafe(F.col("_key")) & F.col("_part").eqNullSafe(F.col("_own")))
    inside = F.row_number().over(Window.partitionBy(KEY, "_part").orderBy(PLACE)) - 1
    return met.select(KEY, PLACE, *channels, (F.col("_before") + inside).alias("_at"), "_n")


def haloed(df: DataFrame, at: str, halo: int, block: int | None) -> tuple[DataFrame, Window, Column]:
    """Rows in every block that has them or is at most halo places away; a window of a block's rows in order; whether a row is the block's own."""
    if block is None:
        return df, Window.partitionBy(KEY).orderBy(at), F.lit(True)
    homes = F.sequence(F.floor((F.col(at) - halo) / block), F.floor((F.col(at) + halo) / block))
    return df.withColumn("_home", F.explode(homes)), Window.partitionBy(KEY, "_home").orderBy(at), F.floor(F.col(at) / block) == F.col("_home")


def of_session(df: DataFrame, found: dict[str, Column], block: int | None) -> DataFrame:
    """df with aggregates of its session as columns."""
    if block is None:
        whole = Window.partitionBy(KEY)
        return df.select("*", *[c.over(whole).alias(name) for name, c in found.items()])
    each = df.groupBy(F.col(KEY).alias("_key")).agg(*[c.alias(name) for name, c in found.items()])
    return df.join(each, F.col(KEY).eqNullSafe(F.col("_key"))).drop("_key")


def carried(df: DataFrame, channels: Sequence[str], block: int | None) -> DataFrame:
    """session, i, channels, and of each channel c the last row with a value up to here (_p_c: i, v) and the first from here on (_n_c)."""
    check(block)
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(PLACE).alias("i"), F.col(c).alias("v")))
    last = lambda x, w: F.last(x, ignorenulls=True).over(w)
    upto = lambda *by: Window.partitionBy(KEY, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, 0)
    if block is None:
        return df.select(KEY, PLACE, *channels, *[last(known(c), upto(PLACE)).alias(f"_p_{c}") for c in channels], *[last(known(c), upto(F.col(PLACE).desc())).alias(f"_n_{c}") for c in channels])
    parted = df.select(KEY, PLACE, *channels, F.floor(F.col(PLACE) / block).alias("_part"))
    ends = parted.groupBy(KEY, "_part").agg(*[F.max_by(known(c), F.when(F.col(c).isNotNull(), F.col(PLACE))).alias(f"_l_{c}") for c in channels], *[F.min_by(known(c), F.when(F.col(c).isNotNull(), F.col(PLACE))).alias(f"_f_{c}") for c in channels])
    before = lambda by: Window.partitionBy(KEY).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    beyond = ends.select(
        F.col(KEY).alias("_key"), F.col("_part").alias("_own"),
        *[last(F.col(f"_l_{c}"), before("_part")).alias(f"_bp_{c}") for c in channels], *[last(F.col(f"_f_{c}"), before(F.col("_part").desc())).alias(f"_bn_{c}") for c in channels],
    )
    met = parted.join(beyond, F.col(KEY).eqNullSafe(F.col("_key")) & F.col("_part").eqNullSafe(F.col("_own")))
    inside = [F.coalesce(last(known(c), upto("_part", PLACE)), F.col(f"_bp_{c}")).alias(f"_p_{c}") for c in channels]
    ahead = [F.coalesce(last(known(c), upto("_part", F.col(PLACE).desc())), F.col(f"_bn_{c}")).alias(f"_n_{c}") for c in channels]
    return met.select(KEY, PLACE, *channels, *inside, *ahead)
