"""Interpolation by cubic pieces between known values."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import blocks as B

KEY, PLACE = B.KEY, B.PLACE


def slopes_not_a_knot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes at the knots of the cubic spline whose third derivative is continuous at the second and the last but one knot.

    Two knots give a line, three a parabola. The system has three diagonals, but
    for one more element in the first and the last row, which go before it is solved.
    """
    n, h = len(x), np.diff(x)
    line = np.diff(y) / h
    if n == 2:
        return np.repeat(line, 2)
    if n == 3:
        bend = (line[1] - line[0]) / (x[2] - x[0])
        return np.array([line[0] - bend * h[0], line[0] + bend * h[0], line[1] + bend * h[1]])
    low, mid, up, b = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
    low[1:-1], mid[1:-1], up[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    b[1:-1] = 3 * (h[1:] * line[:-1] + h[:-1] * line[1:])
    a, z = x[2] - x[0], x[-1] - x[-3]
    mid[0], up[0], b[0] = h[1], a, ((h[0] + 2 * a) * h[1] * line[0] + h[0] ** 2 * line[1]) / a
    low[-1], mid[-1], b[-1] = z, h[-2], (h[-1] ** 2 * line[-2] + (2 * z + h[-1]) * h[-2] * line[-1]) / z
    for i in range(1, n):  # down, and back up
        f = low[i] / mid[i - 1]
        mid[i] -= f * up[i - 1]
        b[i] -= f * b[i - 1]
    out = np.empty(n)
    out[-1] = b[-1] / mid[-1]
    for i in range(n - 2, -1, -1):
        out[i] = (b[i] - up[i] * out[i + 1]) / mid[i]
    return out


def _piece(x: Column, x0: Column, y0: Column, d0: Column, x1: Column, y1: Column, d1: Column) -> Column:
    """The cubic with these values and slopes at x0 and x1."""
    h = x1 - x0
    t = (x - x0) / h
    return y0 * (1 + 2 * t) * (1 - t) * (1 - t) + h * d0 * t * (1 - t) * (1 - t) + y1 * t * t * (3 - 2 * t) + h * d1 * t * t * (t - 1)


def _knots(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNotNull()).select(KEY, PLACE, F.col(c).cast("double").alias("y"))


def _pchip(knots: DataFrame, block: int | None) -> DataFrame:
    """knots with the slope d at each, from two knots on both sides."""
    rows, w, own = B.haloed(B.numbered(knots, ["y"], block), "_at", 2, block)
    near = lambda c, k: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w) if k else F.col(c)
    wide = rows.select(KEY, PLACE, "y", "_at", "_n", own.alias("_mine"), *[near(c, k).alias(f"{c}{k + 2}") for c in (PLACE, "y") for k in range(-2, 3)])
    x, y = lambda k: F.col(f"{PLACE}{k + 2}"), lambda k: F.col(f"y{k + 2}")
    h, m = lambda k: x(k + 1) - x(k), lambda k: (y(k + 1) - y(k)) / (x(k + 1) - x(k))

    def end(h0: Column, m0: Column, h1: Column, m1: Column) -> Column:
        """Of a parabola through three knots; 0 if it turns, at most three times the line's."""
        d = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
        return F.when(F.signum(d) != F.signum(m0), F.lit(0.0)).when((F.signum(m0) != F.signum(m1)) & (F.abs(d) > 3 * F.abs(m0)), 3 * m0).otherwise(d)

    w1, w2 = 2 * h(0) + h(-1), h(0) + 2 * h(-1)
    inner = F.when(m(-1) * m(0) <= 0, F.lit(0.0)).otherwise((w1 + w2) / (w1 / m(-1) + w2 / m(0)))
    first, last = F.col("_at") == 0, F.col("_at") == F.col("_n") - 1
    slope = (
        F.when(F.col("_n") < 2, F.lit(0.0)).when(F.col("_n") == 2, F.when(first, m(0)).otherwise(m(-1)))
        .when(first, end(h(0), m(0), h(1), m(1))).when(last, end(h(-1), m(-1), h(-2), m(-2))).otherwise(inner)
    )
    return wide.select(KEY, PLACE, "y", slope.alias("d"), "_mine").where("_mine").drop("_mine")


def _solved(table: pa.Table) -> pa.Table:
    table = table.sort_by(PLACE)
    x, y = table.column(PLACE).to_numpy().astype(np.float64), table.column("y").to_numpy()
    return table.append_column("d", pa.array(slopes_not_a_knot(x, y) if len(x) > 1 else np.zeros(len(x))))


def interpolate(df: DataFrame, channels: Sequence[str], method: str, block: int | None = None) -> DataFrame:
    """See signal.interpolate()."""
    ship(df.sparkSession)
    out = df.select(KEY, PLACE, *channels)
    whole = [df.schema[KEY], df.schema[PLACE]]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole)
    for k, c in enumerate(channels):
        knots = _knots(df, c)
        sloped = _pchip(knots, block) if method == "pchip" else knots.groupBy(KEY).applyInArrow(_solved, f"{ddl}, y double, d double")
        named = sloped.select(F.col(KEY).alias("_k"), F.col(PLACE).alias("_i"), F.struct("y", "d").alias(f"_knot{k}"))
        out = out.join(named, F.col(KEY).eqNullSafe(F.col("_k")) & (F.col(PLACE) == F.col("_i")), "left").drop("_k", "_i")
    near = B.carried(out, [f"_knot{k}" for k in range(len(channels))], block)

    def fill(k: int) -> Column:
        p, n = f"_p__knot{k}", f"_n__knot{k}"
        piece = _piece(F.col(PLACE), F.col(f"{p}.i"), F.col(f"{p}.v.y"), F.col(f"{p}.v.d"), F.col(f"{n}.i"), F.col(f"{n}.v.y"), F.col(f"{n}.v.d"))
        return F.when(F.col(f"_knot{k}").isNotNull(), F.col(f"_knot{k}.y")).when(F.col(p).isNull(), F.lit(None)).when(F.col(n).isNull(), F.col(f"{p}.v.y")).otherwise(piece)

    return near.select(KEY, PLACE, *[fill(k).alias(c) for k, c in enumerate(channels)]).na.drop(subset=list(channels))
