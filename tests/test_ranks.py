import numpy as np
import pytest
from ocuspark.operators import ranks as R
from ocuspark.operators import segments as G
from ocuspark.operators import signal as S
from ocuspark.operators import targets as T
from ocuspark.operators import training as TR
from ocuspark.sources import files
from pyspark.sql import functions as F
from pyspark.sql import types as ST


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_ranks_of_a_whole_table(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(int(a), float(b)) for a, b in zip(rng.integers(0, 9, 200), rng.normal(size=200), strict=True)] + [(None, 1.0), (3, None)]
    df = spark.createDataFrame(rows, "a int, b double").repartition(7)
    got = R.ranked(df, [F.col("a").desc(), F.col("b")], parts).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or 0))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r["rank"])] == want and {r.n for r in got} == {202}
    assert sorted(r["rank"] for r in got) == list(range(202))
    assert R.ranked(df.limit(0), ["a"]).collect() == []


def test_no_task_sees_all_users(spark):
    samples = spark.range(3000).select(F.col("id").alias("pos"), F.concat(F.lit("u"), (F.col("id") % 700).cast("string")).alias("name"), F.lit(False).alias("skip"))
    records = samples.select(F.col("name").alias("user_id"), F.timestamp_seconds(F.col("pos") * 1000).alias("ts"))
    shares = {"train": 0.5, "test": 0.3, "validation": 0.2}
    for df in (T.random_split(samples, shares, 3), T.ordered_split(samples, shares), T.index(T.configuration(samples)), T.time_based_split(records, shares, "1 hour", 3)):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["split"]: r["count"] for r in T.random_split(samples, shares, 3).groupBy("split").count().collect()} == {"train": 350, "test": 210, "validation": 140}
    segments = spark.range(9000).select((F.col("id") % 5000).alias("session"), F.floor(F.col("id") / 5000).alias("segment_idx"))
    want = {k: n for n, k in enumerate(sorted((i % 5000, i // 5000) for i in range(9000)))}
    assert all(r.guid == want[r.session, r.segment_idx] for r in G.renumber(segments).collect())


@pytest.mark.parametrize(("few", "bins"), [(10_000, 256), (3, 64)])
def test_medians(spark, few, bins):
    rng = np.random.default_rng(1)
    groups = {"n": rng.normal(size=301), "even": rng.normal(size=300).round(1), "same": np.full(50, 2.5), "two": np.array([1e-300, 3.0]), "one": np.array([-7.0]), "wide": rng.normal(size=99) * 10.0 ** rng.integers(-6, 6, 99), "huge": np.array([-1.7e308, 1.7e308, 1.0, 2.0, 3.0])}
    rows = [(k, j % 2, float(v)) for k, vs in groups.items() for j, v in enumerate(vs)] + [("none", 0, None), (None, 1, 4.0), ("n", 0, float("nan"))]
    df = spark.createDataFrame(rows, "g string, h long, v double").repartition(5)
    got = {r.g: r.median for r in R.medians(df, ["g"], "v", few, bins).collect()}
    assert got == {**{k: pytest.approx(float(np.median(v)), rel=1e-15) for k, v in groups.items()}, "none": None, None: 4.0}
    both = {(r.g, r.h): r.median for r in R.medians(df, ["g", "h"], "v", few, bins).collect()}
    assert all(both[k, j] == pytest.approx(float(np.median(v[j::2])), rel=1e-15) for k, v in groups.items() for j in (0, 1) if len(v[j::2]))
    whole, counted = ({(r.g): (r.mean, r.median, r.min) for r in S.quantitative_stats(df.where("not isnan(v)"), ["g"], "v", w).collect()} for w in (True, False))
    assert whole.keys() == counted.keys() and all(whole[k][1] == pytest.approx(counted[k][1], rel=1e-12) for k in groups if k != "huge")


def test_regression_heads(spark):
    """Least squares equals a direct solve; smooth-L1 equals a direct search, and far points pull it less; odd rows."""
    rng = np.random.default_rng(3)
    x, true = rng.normal(size=(80, 3)), rng.normal(size=(2, 4))
    y = x @ true[:, :3].T + true[:, 3] + rng.normal(0, 0.3, (80, 2))
    y[:9, 0] += 40
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)] + [(None, [1.0, 2.0]), ([1.0, None, 2.0], [1.0, 2.0])], "embedding array<double>, target array<double>").repartition(4)

    def table(head):
        w = np.zeros((2, 4))
        for r in head.weights.collect():
            w[r.o, r.j] = r.w
        for r in head.bias.collect():
            w[r.o, 3] = r.b
        return w

    whole = np.column_stack([x, np.ones(80)])
    assert np.allclose(table(TR.fit_regression_head(df)), np.linalg.lstsq(whole, y, rcond=None)[0].T, rtol=0, atol=1e-9)
    ridge = np.linalg.solve(whole.T @ whole + np.diag([2.0, 2, 2, 0]), whole.T @ y).T
    assert np.allclose(table(TR.fit_regression_head(df, decay=2.0)), ridge, rtol=0, atol=1e-9)
    robust = table(TR.fit_regression_head(df, "smooth_l1", rounds=200))
    w = np.linalg.lstsq(whole, y, rcond=None)[0].T
    for _ in range(20_000):  # plain gradient descent on the loss itself
        w -= 0.02 * np.clip(whole @ w.T - y, -1, 1).T @ whole / 80 * 5
    assert np.allclose(robust, w, rtol=0, atol=1e-5) and np.abs(robust - true).max() < 0.5 < np.abs(table(TR.fit_regression_head(df)) - true).max()
    for bad, kind in ((df.limit(0), "no rows"), (df.union(spark.createDataFrame([([1.0], [1.0])], df.schema)), "differ")):
        with pytest.raises(ValueError, match=kind):
            TR.fit_regression_head(bad)
    with pytest.raises(ValueError):
        TR.fit_regression_head(df, "huber")


def test_samples_in_files_of_their_numbers(spark, tmp_path):
    """A folder of 0.json, 1.json, … is in the order of the numbers, not of the names."""
    for i in range(12):
        (tmp_path / f"{i}.json").write_text(f'{{"guid": "g{i}",\n "label": {i % 3}}}')
    (tmp_path / "notes.txt").write_text("not a sample")
    schema = ST.StructType.fromDDL("guid string, label int")
    got = files.load_numbered(spark, str(tmp_path), schema).collect()
    assert [(r.pos, r.guid, r.label) for r in got] == [(i, f"g{i}", i % 3) for i in range(12)]
    assert [r.pos for r in files.load_numbered(spark, str(tmp_path), schema, n_samples=3).collect()] == [0, 1, 2]
    (tmp_path / "x.json").write_text("{}")
    with pytest.raises(Exception, match="no number"):
        files.load_numbered(spark, str(tmp_path), schema).collect()
    with pytest.raises(ValueError):
        files.load_numbered(spark, str(tmp_path / "none"), schema)
