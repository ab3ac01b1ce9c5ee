"""Operators on sequences in long form: a row for each session and place i, a column for each channel.

Every operator works by session and place, so one exchange on the session
serves a whole chain of them. That is for sessions of bounded length, whatever
their number. Filters and interpolation take sessions of any length in blocks of
`block` places (see blocks.py), with the same results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip as clip_column
from ..functions.columns import ratio
from ..functions.stencils import Axis, pick, stencil_1d, stencil_2d
from . import blocks as B
from . import splines
from .ranks import medians

KEY, PLACE = "session", "i"


def _session() -> Window:
    return Window.partitionBy(KEY)


def _ordered() -> Window:
    return Window.partitionBy(KEY).orderBy(PLACE)


def recordings(events: DataFrame) -> DataFrame:
    """Events of a user as a recording of two channels: session, i, x (value) and y (k of props)."""
    # named before the window, so that all later windows by session reuse its exchange
    named = events.select(
        F.col("user_id").alias(KEY), "ts", "event_id", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y")
    )
    order = Window.partitionBy(KEY).orderBy("ts", "event_id")
    return named.select(KEY, (F.row_number().over(order) - 1).cast("bigint").alias(PLACE), "x", "y")


def length(df: DataFrame) -> DataFrame:
    return df.groupBy(KEY).agg(F.count("*").alias("length"))


def diff_velocity(df: DataFrame, channels: Sequence[str], sampling_frequency: float, block: int | None = None) -> DataFrame:
    """Central differences; 0 at both ends of a session."""
    if sampling_frequency <= 0:
        raise ValueError("the sampling frequency must be above 0")
    B.check(block)
    rows, w, own = (df, _ordered(), None) if block is None else B.haloed(B.numbered(df, channels, block), "_at", 1, block)
    inner = F.lag(PLACE).over(w).isNotNull() & F.lead(PLACE).over(w).isNotNull()
    step = lambda c: sampling_frequency / 2 * (F.lead(c).over(w) - F.lag(c).over(w))
    out = [F.when(inner, step(c)).otherwise(F.lit(0.0)).alias(c) for c in channels]
    if own is None:
        return rows.select(KEY, PLACE, *out)
    return rows.select(KEY, PLACE, *out, own.alias("_mine")).where("_mine").drop("_mine")


def savgol(
    df: DataFrame, channels: Sequence[str], window: int, order: int, derivative: str | int = 0, rate: float = 1.0, erroneous: str = "null", block: int | None = None
) -> DataFrame:
    """Savitzky-Golay filter of each channel, or its derivative.

    Ends are padded by reflection: below the first value before it, above the
    last after it. Sessions not longer than half a window cannot be filtered:
    erroneous says whether their values become null, are kept, or are dropped.
    Values within a session come from leads and lags, those beyond its ends from
    its first and last ones.
    """
    if erroneous not in ("null", "keep", "drop"):
        raise ValueError("erroneous must be null, keep or drop")
    weights = stencil_1d(window, order, derivative, rate)
    h = window // 2
    at, n = F.col("_at"), F.col("_n")

    def ends(c: str) -> dict[str, Column]:
        """The first h + 1 values of a session and, from its end, the last ones."""
        value = lambda place: F.max(F.when(at == place, F.col(c)))
        return {f"_first_{m}_{c}": value(F.lit(m)) for m in range(h + 1)} | {f"_last_{m}_{c}": value(n - 1 - m) for m in range(h + 1)}

    whole = B.of_session(B.numbered(df, channels, block), {k: v for c in channels for k, v in ends(c).items()}, block)
    rows, w, own = B.haloed(whole, "_at", h, block)
    packed = [F.array(*[f"_{end}_{m}_{c}" for m in range(h + 1)]).alias(f"_{end}_{c}") for c in channels for end in ("first", "last")]
    near = lambda c, k: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w) if k else F.col(c)
    wide = rows.select(KEY, PLACE, *channels, "_at", "_n", own.alias("_mine"), *packed, *[near(c, k).alias(f"_{k + h}_{c}") for c in channels for k in range(-h, h + 1)])

    def smooth(c: str) -> Column:
        first, last = F.col(f"_first_{c}"), F.col(f"_last_{c}")
        total = F.lit(0.0)
        for k, weight in zip(range(-h, h + 1), weights, strict=True):
            value = F.col(f"_{k + h}_{c}")
            if k < 0:
                value = F.when(at + k < 0, first[0] - F.abs(F.get(first, -(at + k)) - first[0])).otherwise(value)
            elif k > 0:
                value = F.when(at + k >= n, last[0] + F.abs(F.get(last, at + k - (n - 1)) - last[0])).otherwise(value)
            total = total + value * F.lit(weight)
        return F.when(n > h, total).otherwise(F.col(c) if erroneous == "keep" else F.lit(None).cast("double"))

    wide = wide if block is None else wide.where("_mine")
    kept = wide.where(n > h) if erroneous == "drop" else wide
    return kept.select(KEY, PLACE, *[smooth(c).alias(c) for c in channels])


def _padded(df: DataFrame, pairs: Sequence[tuple[str, str]], h: int, block: int | None = None) -> DataFrame:
    """Rows -h .. T-1+h of channel pairs; of each pair k: far and adjacent left padding, both channels, right padding, as a struct p<k>.

    A row near an end is also the reflected one beyond it.
    """
    channels = sorted({c for pair in pairs for c in pair})
    rows = B.numbered(df, channels, block).where(F.col("_n") > h)
    ends = {f"_f_{c}": F.max(F.when(F.col("_at") == 0, F.col(c))) for c in channels} | {f"_e_{c}": F.max(F.when(F.col("_at") == F.col("_n") - 1, F.col(c))) for c in channels}
    rows = B.of_session(rows, ends, block)
    k, n = F.col("_at"), F.col("_n")
    nothing = F.expr("cast(array() as array<bigint>)")
    before = F.when((k >= 1) & (k <= h), F.array(-k.cast("bigint"))).otherwise(nothing)
    after = F.when((k >= n - 1 - h) & (k <= n - 2), F.array((2 * (n - 1) - k).cast("bigint"))).otherwise(nothing)
    at = rows.select(
        KEY, n.alias("n"), F.explode(F.concat(F.array(k.cast("bigint")), before, after)).alias("r"),
        *[F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in channels]).alias(name) for name, prefix in (("v", ""), ("f", "_f_"), ("e", "_e_"))],
    )
    above, below = F.col("r") < 0, F.col("r") >= F.col("n")

    def one(a: str, b: str) -> Column:
        v, f, e = ({"a": F.col(x)[a], "b": F.col(x)[b]} for x in "vfe")
        right = lambda v: v["b"] + F.abs(v["a"] - v["b"])
        below_a, below_b = e["a"] + F.abs(v["a"] - e["a"]), e["b"] + F.abs(v["b"] - e["b"])
        below_right = e["b"] + F.abs(v["a"] - e["b"])
        left = v["a"] - F.abs(v["b"] - v["a"])
        above_left = f["a"] - F.abs(v["b"] - f["a"])
        return F.struct(
            F.when(above, above_left).when(below, below_a - F.abs(below_right - below_a)).otherwise(left).alias("far"),
            F.when(above, above_left).when(below, below_a - F.abs(below_b - below_a)).otherwise(left).alias("adjacent"),
            F.when(above, f["a"] - F.abs(v["a"] - f["a"])).when(below, below_a).otherwise(v["a"]).alias("a"),
            F.when(above, f["b"] - F.abs(v["b"] - f["b"])).when(below, below_b).otherwise(v["b"]).alias("b"),
            F.when(above, right(f) - F.abs(right(v) - right(f))).when(below, below_right).otherwise(right(v)).alias("right"),
        )

    return at.select(KEY, "r", "n", *[one(a, b).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])


def savgol_2d_taps(window: int, order: int, axis: Axis | str) -> list[tuple[int, int, dict[str, float]]]:
    """For each channel of a pair and row offset: the weights of the fields of _padded()."""
    h, kernel = window // 2, stencil_2d(window, order, axis)
    out = []
    for channel in (0, 1):
        for offset in range(-h, h + 1):
            weights = {"far": 0.0, "adjacent": 0.0, "a": 0.0, "b": 0.0, "right": 0.0}
            for j in range(-h, h + 1):
                column = channel + j
                name = "far" if column < -1 else "adjacent" if column == -1 else "a" if column == 0 else "b" if column == 1 else "right"
                weights[name] += float(kernel[offset + h, j + h])
            out.append((channel, offset, weights))
    return out


def savgol_2d(df: DataFrame, a: str, b: str, window: int, order: int, axis: Axis | str = Axis.NONE, block: int | None = None) -> DataFrame:
    """Polynomial surface over time and a pair of channels; its value, or derivative along time or channels.

    Both derivatives (BOTH) have a column each: <channel>_column and <channel>_row.
    Sessions not longer than half a window give no rows.
    """
    found = savgol_2d_pairs(df, [a, b], window, order, axis, [(a, b)], block)
    return found.select(KEY, PLACE, *[F.col(c).alias(c.removeprefix("p0_")) for c in found.columns[2:]])


def savgol_2d_pairs(
    df: DataFrame, channels: Sequence[str], window: int, order: int, axis: Axis | str = Axis.NONE, pairs: Sequence[tuple[str, str]] | None = None, block: int | None = None
) -> DataFrame:
    """savgol_2d() of several pairs of channels side by side: columns p<k>_<channel> of the k-th pair.

    Without pairs, each channel is paired with the next one. A channel may be in
    several pairs; one that is not among channels is an error.
    """
    pairs = list(pairs) if pairs is not None else list(zip(channels, channels[1:], strict=False))
    if not pairs or any(len(p) != 2 or c not in channels for p in pairs for c in p):
        raise ValueError(f"pairs of the channels {', '.join(channels)} are needed, not {pairs}")
    h, axis = window // 2, pick(Axis, axis)
    axes = [Axis.COLUMN, Axis.ROW] if axis is Axis.BOTH else [axis]
    rows, w, own = B.haloed(_padded(df, pairs, h, block), "r", h, block)

    def total(k: int, one: Axis, ch: int) -> Column:
        taps = [(offset, weights) for channel, offset, weights in savgol_2d_taps(window, order, one) if channel == ch]
        return sum((F.lead(sum((F.lit(x) * F.col(f"p{k}.{c}") for c, x in weights.items()), F.lit(0.0)), offset).over(w) for offset, weights in taps), F.lit(0.0))

    end = {x: f"_{x.value}" if len(axes) > 1 else "" for x in axes}
    out = [total(k, x, ch).alias(f"p{k}_{c}{end[x]}") for k, pair in enumerate(pairs) for x in axes for ch, c in enumerate(pair)]
    found = rows.select(KEY, F.col("r").alias(PLACE), "n", own.alias("_mine"), *out)
    return found.where((F.col(PLACE) >= 0) & (F.col(PLACE) < F.col("n")) & F.col("_mine")).drop("n", "_mine")


def zscore(df: DataFrame, channels: Sequence[str], mean: float | None = None, std: float | None = None) -> DataFrame:
    """(x - mean) / std of each channel of a session, population std; a std of 0 gives null. Constants replace either."""
    w = _session()
    m = lambda c: F.avg(c).over(w) if mean is None else F.lit(float(mean))
    s = lambda c: F.stddev_pop(c).over(w) if std is None else F.lit(float(std))
    return df.select(KEY, PLACE, *[ratio(F.col(c) - m(c), s(c)).alias(c) for c in channels])


def zscore_by_step(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """The same across the channels of each place."""
    n = len(channels)
    mean = sum((F.col(c) for c in channels[1:]), F.col(channels[0])) / n
    var = sum(((F.col(c) - mean) * (F.col(c) - mean) for c in channels[1:]), (F.col(channels[0]) - mean) * (F.col(channels[0]) - mean)) / n
    return df.select(KEY, PLACE, *[ratio(F.col(c) - mean, F.sqrt(var)).alias(c) for c in channels])


def minmax(df: DataFrame, channels: Sequence[str], low: float = 0.0, high: float = 1.0, clipped: bool = False) -> DataFrame:
    """Each channel of a session on [low, high]; a constant channel gives null."""
    w = _session()
    scaled = lambda c: ratio(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)) * (high - low) + low
    return df.select(KEY, PLACE, *[(clip_column(scaled(c), low, high) if clipped else scaled(c)).alias(c) for c in channels])


def clip(df: DataFrame, channels: Sequence[str], low: float, high: float) -> DataFrame:
    return df.select(KEY, PLACE, *[clip_column(F.col(c), low, high).alias(c) for c in channels])


def mask_bad(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """bad: any channel is below 0; channels of bad rows become null."""
    bad = F.lit(False)
    for c in channels:
        bad = bad | F.coalesce(F.col(c) < 0, F.lit(False))
    return df.withColumn("bad", bad).select(KEY, PLACE, "bad", *[F.when(~F.col("bad"), F.col(c)).alias(c) for c in channels])


def retain(masked: DataFrame, beaten_ratio: float = 30.0, min_length: int = 500) -> DataFrame:
    """Rows of sessions with under beaten_ratio percent of bad rows and at least min_length rows."""
    w = _session()
    n, bad = F.count("*").over(w), F.sum(F.col("bad").cast("int")).over(w)
    return masked.withColumns({"n": n, "n_bad": bad}).where((F.col("n") >= min_length) & (100.0 * F.col("n_bad") / F.col("n") < beaten_ratio)).drop("n", "n_bad")


METHODS = ("linear", "previous", "next", "nearest", "pchip", "cubicspline")


def interpolate(df: DataFrame, channels: Sequence[str], method: str = "linear", block: int | None = None) -> DataFrame:
    """Nulls between values by straight lines, from the value before, after, or nearest (of two as near, the one before), or by cubic pieces.

    pchip keeps the shape: slopes at values are weighted harmonic means of those
    of the lines on both sides, 0 at turning points. cubicspline has continuous
    curvature (and a continuous third derivative next to both ends), for which
    all values of a session and channel are solved together, by one task; the
    others take sessions of any length in blocks. Trailing nulls take the last
    value; rows with a leading one go, but for the methods that look ahead, by
    which it takes the first value. Values ahead are those before in descending
    order, so that no frame is gone through again for each row.
    """
    if method not in METHODS:
        raise ValueError(f"{method} is none of {', '.join(METHODS)}")
    if method in ("pchip", "cubicspline"):
        return splines.interpolate(df, channels, method, block)

    def fill(c: str) -> Column:
        p, pi, n, ni = F.col(f"_p_{c}.v"), F.col(f"_p_{c}.i"), F.col(f"_n_{c}.v"), F.col(f"_n_{c}.i")
        if method == "linear":
            inner = F.when(p.isNull() | n.isNull(), p).otherwise(p + (n - p) * (F.col(PLACE) - pi) / (ni - pi))
        elif method == "previous":
            inner = p
        elif method == "next":
            inner = F.coalesce(n, p)
        else:
            inner = F.when(p.isNull() | (ni - F.col(PLACE) < F.col(PLACE) - pi), n).otherwise(p)
        return F.when(F.col(c).isNotNull(), F.col(c)).otherwise(inner)

    return B.carried(df, channels, block).select(KEY, PLACE, *[fill(c).alias(c) for c in channels]).na.drop(subset=list(channels))


def clean(df: DataFrame, channels: Sequence[str], beaten_ratio: float = 30.0, min_length: int = 500, method: str = "linear") -> DataFrame:
    """mask_bad, retain and interpolate."""
    return interpolate(retain(mask_bad(df, channels), beaten_ratio, min_length), channels, method)


def transpose(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Channels as rows: session, ch, i, v."""
    pairs = F.array(*[F.struct(F.lit(k).alias("ch"), F.col(c).alias("v")) for k, c in enumerate(channels)])
    return df.select(KEY, PLACE, F.explode(pairs).alias("p")).select(KEY, "p.ch", PLACE, "p.v")


def quantitative_stats(df: DataFrame, by: Sequence[str], value: str, whole_groups: bool = True) -> DataFrame:
    """Mean, population std, median, least and largest value of each group.

    An exact median holds a group's distinct values in one task; without
    whole_groups it is found by counts (ranks.medians()), for groups of any size.
    """
    of = {"mean": F.avg(value), "std": F.stddev_pop(value), "min": F.min(value), "max": F.max(value)}
    if whole_groups:
        return df.groupBy(*by).agg(*[of[k].alias(k) for k in ("mean", "std")], F.percentile(value, 0.5).alias("median"), *[of[k].alias(k) for k in ("min", "max")])
    keys = [F.col(c).alias(f"_of_{i}") for i, c in enumerate(by)]
    middle = medians(df, by, value).select(*keys, "median")
    others = df.groupBy(*by).agg(*[c.alias(k) for k, c in of.items()])
    return others.join(middle, [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(by)]).select(*by, "mean", "std", "median", "min", "max")


def categorical_stats(df: DataFrame, value: str) -> DataFrame:
    """A row for each category: its count, and number of categories, least and largest count."""
    counts = df.groupBy(value).agg(F.count("*").alias("count"))
    whole = counts.agg(F.count("*").alias("number"), F.min("count").alias("min_count"), F.max("count").alias("max_count"))
    return counts.withColumn("k", F.lit(0)).join(F.broadcast(whole.withColumn("k", F.lit(0))), "k").drop("k")
