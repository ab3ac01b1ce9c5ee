import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ocuspark.functions.stencils import Axis, pick, stencil_1d, stencil_2d
from ocuspark.operators import segments as G
from ocuspark.operators import signal as S

SWEEP = [(5, 2), (7, 3), (9, 3), (11, 5), (13, 5), (15, 7), (17, 7), (19, 9), (21, 9)]


def frame(spark, series):
    rows = [(s, i, None if v is None else float(v)) for s, xs in enumerate(series) for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "session long, i long, x double").repartition(3)


def back(df, n, col="x"):
    got = {(r.session, r.i): r[col] for r in df.collect()}
    return [[got.get((s, i)) for i in range(k)] for s, k in enumerate(n)]


def reflected(x, h):
    head = [x[0] - abs(v - x[0]) for v in x[h:0:-1]]
    tail = [x[-1] + abs(v - x[-1]) for v in x[-2 : -2 - h : -1]]
    return np.array([*head, *x, *tail])


@pytest.mark.parametrize(("window", "order"), SWEEP)
def test_savgol_is_the_padded_correlation(spark, window, order):
    rng = np.random.default_rng(window)
    series = [rng.normal(size=n).tolist() for n in (window, 40, window // 2 + 1, window // 2)]
    got = back(S.savgol(frame(spark, series), ["x"], window, order), [len(x) for x in series])
    h, m = window // 2, np.array(stencil_1d(window, order))
    for x, y in zip(series, got, strict=True):
        if len(x) > h:
            assert np.allclose(y, np.correlate(reflected(x, h), m, "valid"), atol=1e-6)
        else:
            assert y == [None] * len(x)


@settings(max_examples=40, deadline=None)
@given(st.sampled_from(SWEEP), st.lists(st.floats(-3, 3), min_size=3, max_size=3), st.integers(0, 2))
def test_stencils_reproduce_polynomials(shape, coefficients, derivative):
    window, order = shape
    t = np.arange(-(window // 2), window // 2 + 1, dtype=float)
    p = np.polynomial.Polynomial(coefficients)
    d = p.deriv(derivative) if derivative else p
    assert np.dot(stencil_1d(window, order, derivative), p(t)) == pytest.approx(d(0.0), abs=1e-5)


def test_sessions_that_cannot_be_filtered(spark):
    df = frame(spark, [[1, 2, 3], range(10)])
    assert back(S.savgol(df, ["x"], 7, 3, erroneous="keep"), [3, 10])[0] == [1, 2, 3]
    assert S.savgol(df, ["x"], 7, 3, erroneous="drop").count() == 10
    with pytest.raises(ValueError):
        S.savgol(df, ["x"], 7, 3, erroneous="ignore")


def test_known_stencils():
    assert np.allclose(stencil_1d(7, 3), np.array([-2, 3, 6, 7, 6, 3, -2]) / 21)
    assert np.allclose(stencil_1d(7, 3, "first_order"), np.array([22, -67, -58, 0, 58, 67, -22]) / 252)
    assert np.allclose(stencil_1d(7, 3, 1, rate=10.0), np.array(stencil_1d(7, 3, 1)) * 10)
    assert pick(Axis, "COLUMN") is Axis.COLUMN


@pytest.mark.parametrize("bad", [(4, 2, 0), (1, 0, 0), (5, 4, 0), (-7, 3, 0), (7, 3, 3), (7, 3, "third"), (7, 1, 2)])
def test_bad_parameters_are_refused(bad):
    with pytest.raises(TypeError):
        stencil_1d(*bad)


def eight_regions(a, h):
    """The whole reflect padding of a [T, 2] pair, region by region."""
    t, n = a.shape
    out = np.zeros((t + 2 * h, n + 2 * h))
    out[h:-h, h:-h] = a
    first, last = a[:1], a[-1:]
    out[:h, h:-h] = first - np.abs(a[1 : h + 1][::-1] - first)
    out[-h:, h:-h] = last + np.abs(a[-h - 1 : -1][::-1] - last)
    return out


def test_savgol_2d_interior_and_surface(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2, 30))
    df = spark.createDataFrame([(0, i, float(x[i]), float(y[i])) for i in range(30)] + [(1, 0, 1.0, 2.0)], "session long, i long, x double, y double")
    for axis in ("none", "column", "row"):
        k = stencil_2d(5, 2, axis)
        got = {r.i: (r.x, r.y) for r in S.savgol_2d(df, "x", "y", 5, 2, axis).where("session = 0").collect()}
        assert len(got) == 30
        left, right = x - np.abs(y - x), y + np.abs(x - y)
        padded = np.stack([left, left, x, y, right, right], axis=1)
        for i in range(2, 28):
            for c in (0, 1):
                assert got[i][c] == pytest.approx((k * padded[i - 2 : i + 3, c : c + 5]).sum(), abs=1e-9)
        rows = eight_regions(np.stack([x, y], axis=1), 2)
        assert np.allclose(rows[2:-2, 2:-2], np.stack([x, y], axis=1))
    dt, dc = np.meshgrid(np.arange(-2, 3), np.arange(-2, 3), indexing="ij")
    surface = 1 + 2 * dt - 3 * dc + dt * dc
    assert [round(float((stencil_2d(5, 2, a) * surface).sum()), 9) for a in ("none", "column", "row")] == [1, 2, -3]
    with pytest.raises(TypeError):
        stencil_2d(3, 2, "both")


def test_velocity_scaling_and_clipping_edges(spark):
    series = [[1], [1, 4], [5, 5, 5], [0, 1, 4, 9]]
    df = frame(spark, series)
    n = [len(x) for x in series]
    assert back(S.diff_velocity(df, ["x"], 2.0), n) == [[0], [0, 0], [0, 0, 0], [0, 4, 8, 0]]
    assert back(S.zscore(df, ["x"]), n)[2] == [None] * 3
    z = back(S.zscore(df, ["x"]), n)[3]
    assert np.mean(z) == pytest.approx(0) and np.std(z) == pytest.approx(1)
    assert back(S.minmax(df, ["x"], -1, 1), n)[3] == pytest.approx([-1, -7 / 9, -1 / 9, 1])
    assert back(S.minmax(df, ["x"]), n)[0] == [None]
    odd = spark.createDataFrame([(0, 0, None), (0, 1, float("nan")), (0, 2, -9.0), (0, 3, 9.0)], "session long, i long, x double")
    got = back(S.clip(odd, ["x"], -1, 1), [4])[0]
    assert got[0] is None and np.isnan(got[1]) and got[2:] == [-1, 1]
    with pytest.raises(ValueError):
        S.clip(odd, ["x"], 1, -1)
    with pytest.raises(ValueError):
        S.diff_velocity(df, ["x"], 0)


def test_interpolation_equals_pandas(spark):
    rng = np.random.default_rng(4)
    series = [[None if rng.random() < 0.3 else float(v) for v in rng.normal(size=n)] for n in (1, 2, 30, 30)] + [[None, 1.0, None, None, 4.0, None], [None, None]]
    got = back(S.interpolate(frame(spark, series), ["x"]), [len(x) for x in series])
    for x, y in zip(series, got, strict=True):
        want = pd.Series(x, dtype=float).interpolate()
        assert [v is None for v in y] == want.isna().tolist()
        assert [v for v in y if v is not None] == pytest.approx(want.dropna().tolist())


def test_retention_bounds(spark):
    good, edge, short = [1.0] * 10, [-1.0] * 3 + [1.0] * 7, [1.0] * 9
    kept = S.retain(S.mask_bad(frame(spark, [good, edge, short]), ["x"]), 30.0, 10)
    assert {r.session for r in kept.select("session").distinct().collect()} == {0}


@pytest.mark.parametrize(("length", "least"), [(1, 0.5), (2, 0.5), (5, 0.0), (7, 0.85), (10, 0.5), (11, 0.5), (30, 0.1)])
def test_nonoverlapping_counts_and_content(spark, length, least):
    sizes = (1, 9, 10, 20, 21)
    df = frame(spark, [range(n) for n in sizes])
    found = {}
    for r in G.nonoverlapping(df, "x", length, least, -100.0).collect():
        found.setdefault(r.session, {}).setdefault(r.segment_idx, {})[r.pos] = r.v
    for s, n in enumerate(sizes):
        tail = n % length > 0 and n % length / length >= least
        own = found.get(s, {})
        assert sorted(own) == list(range(n // length + tail))
        for k, part in own.items():
            assert [part[p] for p in range(length)] == [float(k * length + p) if k * length + p < n else -100.0 for p in range(length)]


@pytest.mark.parametrize(("length", "step", "least"), [(4, 3, 0.85), (4, 3, 0.5), (1, 1, 0.5), (10, 9, 0.5), (3, 5, 0.0)])
def test_overlapping_counts_and_content(spark, length, step, least):
    sizes = (2, 4, 10, 23)
    rows = G.overlapping(frame(spark, [range(n) for n in sizes]), "x", length, step, least, -1.0).collect()
    for s, n in enumerate(sizes):
        own = {}
        for r in rows:
            if r.session == s:
                own.setdefault(r.segment_idx, {})[r.pos] = r
        full = (n - length) // step + 1 if n >= length else 0
        tail = full > 0 and (length - (length - 1) / 2) / length >= least
        assert sorted(own) == list(range(full + tail))
        for k in range(full):
            assert [own[k][p].v for p in range(length)] == [k * step + p for p in range(length)]
        if tail:
            pad = 0 if length == 1 else max(1, (length - 1) // 2)
            assert [own[full][p].v for p in range(length)] == [*map(float, range(n - length + pad, n)), *[-1.0] * pad]
            assert own[full][0].index_start == n - length + pad and own[full][0].index_end == n


def test_sliding_windows(spark):
    sizes = (1, 3, 4, 9)
    rows = G.sliding(frame(spark, [range(n) for n in sizes]), "x", 4, 3, -1.0).collect()
    for s, n in enumerate(sizes):
        starts = {r.index_start for r in rows if r.session == s}
        assert starts == {0} | {k for k in range(3, n, 3) if k + 4 - 3 < n}
    assert G.sliding_full(frame(spark, [range(3)]), "x", 4, 1).count() == 0
    with pytest.raises(ValueError):
        G.sliding(frame(spark, [range(3)]), "x", 0, 1, 0.0)


def test_guids_run_through_all_sessions(spark):
    segs = G.nonoverlapping(frame(spark, [range(8), range(3), range(5)]), "x", 2, 1.0)
    got = sorted({(r.session, r.segment_idx, r.guid) for r in G.renumber(segs).collect()})
    assert [g for *_, g in got] == list(range(7))
