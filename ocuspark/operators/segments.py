"""Cutting sequences into windows of a fixed number of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked
from .signal import KEY, PLACE


def _check(length: int, step: int = 1) -> None:
    if length < 1 or step < 1:
        raise ValueError("lengths and steps must be 1 at least")


def _spread(df: DataFrame, value: str, starts: Column, length: int, take: Column, fill: float | None) -> DataFrame:
    """Windows of a session's array: segment_idx, index_start, index_end (exclusive), completeness, pos, v.

    starts: array of structs (segment_idx, start); take: number of real places, the rest is fill.
    """
    packed = df.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct(PLACE, value))), lambda r: r[value]).alias("x"))
    each = packed.withColumn("n", F.size("x")).select(KEY, "x", "n", F.explode(starts).alias("w"))
    cut = each.select(KEY, "w.segment_idx", F.col("w.start").alias("index_start"), F.slice("x", F.col("w.start") + 1, length).alias("part"), take.alias("take"))
    filler = F.lit(fill).cast("double")
    pos = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.when(k < F.col("take"), F.get(F.col("part"), k)).otherwise(filler)))
    return cut.select(
        KEY, F.col("segment_idx").cast("bigint").alias("segment_idx"), F.col("index_start").cast("bigint").alias("index_start"),
        (F.col("index_start") + F.col("take")).cast("bigint").alias("index_end"), (F.col("take") / length).alias("completeness"), pos.alias("pos", "v"),
    ).withColumn("pos", F.col("pos").cast("bigint"))


def _windows(count: Column, step: int, more: Column | None = None) -> Column:
    """Structs (segment_idx, start) of count windows, and of one more if its start is not null."""
    base = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(k.cast("int").alias("segment_idx"), (k * step).cast("int").alias("start"))))
    base = F.coalesce(base, F.expr("cast(array() as array<struct<segment_idx:int,start:int>>)"))
    if more is None:
        return base
    extra = F.array(F.struct(F.greatest(count, F.lit(0)).cast("int").alias("segment_idx"), more.cast("int").alias("start")))
    return F.when(more.isNotNull(), F.concat(base, extra)).otherwise(base)


def nonoverlapping(df: DataFrame, value: str, length: int, min_completeness: float = 0.85, fill: float | None = None) -> DataFrame:
    """Full windows, and the padded rest if it holds min_completeness of a window, at least."""
    _check(length)
    n = F.col("n")
    count = F.floor(n / length).cast("int")
    rest = n - count * length
    tail = F.when((rest > 0) & (rest / length >= min_completeness), count * length)
    return _spread(df, value, _windows(count, length, tail), length, F.least(F.lit(length), n - F.col("w.start")), fill)


def overlapping(df: DataFrame, value: str, length: int, step: int, min_completeness: float = 0.85, fill: float | None = None) -> DataFrame:
    """Windows at each step; and the last places of the session, padded, if their fixed share of a window is enough.

    The padding is (length - 1) // 2 places, 1 at least (0 for windows of 1).
    """
    _check(length, step)
    n = F.col("n")
    count = F.when(n >= length, F.floor((n - length) / step) + 1).otherwise(0).cast("int")
    padding = 0 if length == 1 else max(1, (length - 1) // 2)
    wanted = (length - (length - 1) / 2) / length >= min_completeness
    tail = F.when((count > 0) & F.lit(wanted), n - (length - padding))
    take = F.when(F.col("w.segment_idx") == count, F.lit(length - padding)).otherwise(F.lit(length))
    return _spread(df, value, _windows(count, step, tail), length, take, fill)


def sliding(df: DataFrame, value: str, size: int, step: int, fill: float) -> DataFrame:
    """Windows of which each after the first has a new place; what is missing is fill."""
    _check(size, step)
    n = F.col("n")
    count = (1 + F.ceil(F.greatest(n - size, F.lit(0)) / step)).cast("int")
    return _spread(df, value, _windows(count, step), size, F.least(F.lit(size), n - F.col("w.start")), fill)


def sliding_full(df: DataFrame, value: str, size: int, step: int) -> DataFrame:
    """Full windows only, at each step."""
    _check(size, step)
    n = F.col("n")
    count = F.when(n >= size, F.floor((n - size) / step) + 1).otherwise(0).cast("int")
    return _spread(df, value, _windows(count, step), size, F.lit(size), None)


def sliding_2d(long: DataFrame, channels: int, shape: tuple[int, int], dx: int, dy: int) -> DataFrame:
    """Patches of (session, ch, i, v): row and column of the patch, place in it, v."""
    h, w = shape
    _check(min(h, w), min(dx, dy))
    sized = long.withColumn("n", F.max(PLACE).over(Window.partitionBy(KEY)) + 1)

    def homes(at: str, size: int, step: int, total: Column) -> Column:
        """Numbers of the patches that a place is in."""
        last = F.least(F.floor(F.col(at) / step), F.floor((total - size) / step))
        first = F.greatest(F.ceil((F.col(at) - size + 1) / step), F.lit(0))
        return F.when((total >= size) & (first <= last), F.sequence(first.cast("bigint"), last.cast("bigint")))

    rows = sized.withColumn("row", F.explode(homes(PLACE, h, dy, F.col("n"))))
    both = rows.withColumn("col", F.explode(homes("ch", w, dx, F.lit(channels))))
    return both.select(KEY, "row", "col", (F.col(PLACE) - F.col("row") * dy).cast("bigint").alias("y"), (F.col("ch") - F.col("col") * dx).cast("bigint").alias("x"), "v")


def renumber(segments: DataFrame) -> DataFrame:
    """guid: segments in order of session and segment_idx, from 0.

    Segments are counted by session; where a session starts is found from the
    counts of the sessions before it, in ranges of sessions.
    """
    per = ranked(segments.select(KEY, "segment_idx").distinct().groupBy(KEY).agg(F.count("*").alias("k")), [KEY])
    # sums inside spans of 4,096 sessions, and over the spans: one row for as many sessions
    span = F.floor(F.col("rank") / 4096)
    inside_span = F.coalesce(F.sum("k").over(Window.partitionBy("span").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = per.withColumn("span", span).withColumn("inside_span", inside_span)
    spans = summed.groupBy("span").agg(F.sum("k").alias("k"))
    starts = spans.select("span", F.coalesce(F.sum("k").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    before = summed.join(starts, "span").select(KEY, (F.col("start") + F.col("inside_span")).alias("before"))
    inside = F.dense_rank().over(Window.partitionBy(KEY).orderBy("segment_idx")) - 1
    return segments.withColumn("inside", inside).join(before, KEY).withColumn("guid", (F.col("before") + F.col("inside")).cast("bigint")).drop("before", "inside")
