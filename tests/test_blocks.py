"""Sessions in blocks of any size give the rows of whole sessions; padding and splines against plain arrays."""

import numpy as np
import pytest
from ocuspark.functions.stencils import stencil_2d
from ocuspark.operators import blocks as B
from ocuspark.operators import signal as S
from ocuspark.operators.splines import slopes_not_a_knot
from pyspark.sql import functions as F

LENGTHS = (1, 2, 3, 5, 8, 9, 17, 40, 65)


@pytest.fixture(scope="module")
def sessions(spark):
    rng = np.random.default_rng(6)
    rows = []
    for s, n in enumerate(LENGTHS):
        start = [0, 0, 7, -9][s % 4]  # places need not begin at 0
        rows += [(s, start + i, *[None if rng.random() < 0.3 else float(v) for v in rng.normal(size=2)], float(rng.normal()), float(rng.normal())) for i in range(n)]
    rows += [(None, i, None, 1.0, 2.0, float(i)) for i in range(6)]
    return spark.createDataFrame(rows, "session long, i long, x double, y double, a double, b double").repartition(3).cache()


def found(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [8, 64, 3])
def test_blocks_equal_whole_sessions(sessions, block):
    for make in (
        lambda b: S.savgol(sessions, ["a", "b"], 7, 3, block=b),
        lambda b: S.savgol(sessions, ["a"], 5, 2, "first_order", 10.0, "keep", block=b),
        lambda b: S.savgol(sessions, ["a"], 9, 2, erroneous="drop", block=b),
        lambda b: S.savgol_2d(sessions, "a", "b", 5, 2, "both", block=b),
        lambda b: S.savgol_2d_pairs(sessions, ["a", "b"], 7, 3, "row", [("b", "a"), ("a", "b")], block=b),
        lambda b: S.diff_velocity(sessions, ["a", "b"], 100.0, block=b),
        *[lambda b, m=m: S.interpolate(sessions, ["x", "y"], m, block=b) for m in S.METHODS],
    ):
        assert found(make(block)) == found(make(None))


def test_no_task_has_a_whole_long_session(spark):
    """200,000 places of one session, 4,096 a block: rows are equal, and every window is by block."""
    long = spark.range(200_000).select(F.lit(1).cast("long").alias("session"), F.col("id").alias("i"), F.sin(F.col("id") / 50).alias("a"), F.when(F.col("id") % 7 > 0, F.cos(F.col("id") / 30)).alias("b"))
    total = lambda df, c: df.agg(F.count("*"), F.round(F.sum(F.col(c) * (1 + F.col("i") % 11)), 6)).first()
    assert total(S.savgol(long, ["a"], 7, 3, block=4096), "a") == total(S.savgol(long, ["a"], 7, 3), "a")
    assert total(S.interpolate(long, ["b"], block=4096), "b") == total(S.interpolate(long, ["b"]), "b")
    tasks = B.haloed(B.numbered(long, ["a"], 4096), "_at", 3, 4096)[0].groupBy("session", "_home").count()
    assert tasks.count() >= 49 and tasks.agg(F.max("count")).first()[0] <= 4096 + 6
    with pytest.raises(ValueError):
        S.savgol(long, ["a"], 7, 3, block=0)


def padded(z, h):
    """All nine regions of the reflected padding of [time, channel], as the published recipe for two-dimensional filters has them."""
    t, n = z.shape
    big = np.zeros((t + 2 * h, n + 2 * h))
    big[h:-h, h:-h] = z
    top, bottom, left, right = z[:1], z[-1:], z[:, :1], z[:, -1:]
    big[:h, h:-h] = top - np.abs(z[1 : h + 1][::-1] - top)
    big[-h:, h:-h] = bottom + np.abs(z[-h - 1 : -1][::-1] - bottom)
    big[h:-h, :h] = left - np.abs(z[:, 1 : h + 1][:, ::-1] - left)
    big[h:-h, -h:] = right + np.abs(z[:, max(0, n - h - 1) : -1][:, ::-1] - right)
    big[:h, :h] = z[0, 0] - np.abs(z[1 : h + 1, 1 : h + 1][::-1, ::-1] - z[0, 0])
    big[-h:, -h:] = z[-1, -1] + np.abs(z[-h - 1 : -1, max(0, n - h - 1) : -1][::-1, ::-1] - z[-1, -1])
    edge = big[h, -h:]
    big[:h, -h:] = edge - np.abs(big[h + 1 : 2 * h + 1, -h:][::-1] - edge)
    edge = big[-h:, h : h + 1]
    big[-h:, :h] = edge - np.abs(big[-h:, h + 1 : 2 * h + 1][:, ::-1] - edge)
    return big


@pytest.mark.parametrize("window", [3, 5, 7])
@pytest.mark.parametrize("block", [None, 8])
def test_every_row_of_the_two_dimensional_filter(spark, window, block):
    rng, h = np.random.default_rng(window), window // 2
    z = rng.normal(size=(23, 2))
    df = spark.createDataFrame([(4, i, *map(float, z[i])) for i in range(23)], "session long, i long, a double, b double")
    for axis in ("none", "column", "row"):
        kernel, big = stencil_2d(window, 2 if window > 3 else 1, axis), padded(z, h)
        want = [[(kernel * big[t : t + window, c : c + window]).sum() for c in (0, 1)] for t in range(23)]
        got = S.savgol_2d(df, "a", "b", window, 2 if window > 3 else 1, axis, block).orderBy("i").collect()
        assert np.allclose([(r.a, r.b) for r in got], want, rtol=0, atol=1e-12)


def test_splines(spark):
    """A cubic comes back as it was; few knots give a line and a parabola; pchip stays between its neighbours and has the known slopes."""
    cubic = lambda x: 0.5 * x**3 - 2 * x**2 + x - 3
    x = np.array([0.0, 1, 4, 5, 7, 11, 12])
    assert np.allclose(slopes_not_a_knot(x, cubic(x)), 1.5 * x**2 - 4 * x + 1)
    rows = [(0, i, float(cubic(i)) if i in (1, 4, 5, 9, 14) else None) for i in range(17)]
    rows += [(1, 3, 2.0), (1, 5, None), (1, 7, 4.0)] + [(2, i, float(i * i) if i in (0, 3, 4) else None) for i in range(5)] + [(3, 0, None), (3, 1, 5.0), (3, 2, None), (4, 0, None)]
    df = spark.createDataFrame(rows, "session long, i long, x double")
    got = {(r.session, r.i): r.x for r in S.interpolate(df, ["x"], "cubicspline").collect()}
    assert all(got[0, i] == pytest.approx(cubic(i)) for i in range(1, 15)) and (0, 0) not in got and got[0, 16] == got[0, 14]
    assert got[1, 5] == pytest.approx(3) and [got[2, i] for i in range(5)] == pytest.approx([0, 1, 4, 9, 16]) and got[3, 2] == 5 and (4, 0) not in got
    # known slopes: harmonic means inside, 0 at a turn
    steps = spark.createDataFrame([(0, i, v) for i, v in enumerate([0.0, None, 1.0, None, 5.0, None, 4.0, None, 4.0])], "session long, i long, x double")
    got = [r.x for r in S.interpolate(steps, ["x"], "pchip").orderBy("i").collect()]
    d = [0.0] * 5
    d[1] = 2 / (1 / 0.5 + 1 / 2)  # equal steps: the harmonic mean of both lines' slopes
    d[0] = 0.0 if (3 * 0.5 - 2) / 2 <= 0 else (3 * 0.5 - 2) / 2
    known = [0.0, 1.0, 5.0, 4.0, 4.0]
    for k in range(4):
        half = (known[k] + known[k + 1]) / 2 + 2 * (d[k] - d[k + 1]) / 8
        if k < 2:
            assert got[2 * k + 1] == pytest.approx(half)
        assert min(known[k], known[k + 1]) - 1e-12 <= got[2 * k + 1] <= max(known[k], known[k + 1]) + 1e-12
