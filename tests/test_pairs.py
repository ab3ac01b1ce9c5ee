import numpy as np
import pytest
from ocuspark.operators import layers as L
from ocuspark.operators import metrics as M
from ocuspark.operators import pairs as P
from ocuspark.operators import signal as S
from ocuspark.operators import targets as T
from ocuspark.plans import catalogue as C
from ocuspark.plans import pipelines as PL
from pyspark.sql import functions as F

from .oracle import SMALL, connect, spark_rows, sql_rows


def vectors(spark, n, labels=5, size=3, seed=1):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, size)).round(2), rng.integers(0, labels, n)
    return x, y, spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], "vec_id long, label int, embedding array<double>")


@pytest.mark.parametrize("block", [1024, 7])
def test_all_pairs_of_a_set(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    x, y, df = vectors(spark, 40)
    got = {(r.a, r.b): (r.score, r.genuine) for r in P.pair_scores(df).collect()}
    assert got.keys() == {(i, j) for j in range(40) for i in range(j)} and len(got) == 780
    assert all(s == pytest.approx(-np.linalg.norm(x[i] - x[j])) and g == (y[i] == y[j]) for (i, j), (s, g) in got.items())
    assert P.pair_scores(df).count() == 780 and P.pair_scores(df).where("genuine").count() == sum(g for _, g in got.values())
    assert P.pair_scores(df.limit(0)).collect() == [] == P.pair_scores(df.limit(1)).collect()
    names = P.pair_scores(df.withColumn("vec_id", F.format_string("k%03d", "vec_id")).limit(9)).collect()
    assert len(names) == 36 and all(r.a < r.b for r in names)


@pytest.mark.parametrize("block", [1024, 7])
def test_claims_are_counted_where_they_are_made(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    x, y, df = vectors(spark, 50)
    protos = spark.createDataFrame([(k, [float(k), 0.0, 0.5]) for k in range(5)] * 1, "label int, prototype array<double>")
    want = {}
    for v, label in zip(x, y, strict=True):
        for k in range(5):
            key = (round(-float(np.linalg.norm(v - [k, 0, 0.5])), 4), bool(label == k))
            want[key] = want.get(key, 0) + 1
    found = P.claims(df, protos, 4)
    got = {(r.score, r.genuine): r.n for r in found.groupBy("score", "genuine").agg(F.sum("n").alias("n")).collect()}
    assert got == want
    plain = found.select("score", "genuine", F.explode(F.expr("sequence(1, n)")).alias("k")).drop("k")
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(M.fmr_fnmr(found, 4)) == order(M.fmr_fnmr(plain, 4))
    with pytest.raises(Exception, match="differ in size"):
        P.claims(df, spark.createDataFrame([(0, [1.0])], "label int, prototype array<double>")).collect()


@pytest.mark.parametrize(("block", "bins", "digits"), [(1024, 4096, 6), (7, 3, 6), (16, 40, 1), (7, 5, 12)])
def test_equal_error_rate_of_bins_is_that_of_all_scores(spark, monkeypatch, block, bins, digits):
    """Any number of bins; also where classes are apart, mixed, or of one kind only, and with equal scores."""
    monkeypatch.setattr(P, "BLOCK", block)
    for seed, labels, shift in ((1, 4, 1.0), (2, 3, 0.0), (3, 2, 9.0), (4, 1, 0.0), (5, 6, 0.3)):
        rng = np.random.default_rng(seed)
        y = rng.integers(0, labels, 40)
        x = (rng.normal(size=(40, 3)) + shift * y[:, None]).round(1)
        df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(y, x, strict=True)], "label int, embedding array<double>")
        protos = spark.createDataFrame([(k, x[y == k].mean(axis=0).tolist()) for k in range(labels)], "label int, prototype array<double>")
        want = M.eer(M.fmr_fnmr(P.claims(df, protos, digits), 4)).first()
        got = P.equal_error_rate(df, protos, digits, bins).first()
        assert (got.low, got.high, got.eer) == pytest.approx((want.low, want.high, want.eer), abs=1e-12), (seed, labels)
    assert P.equal_error_rate(df.limit(0), protos).first().eer == 1 == P.equal_error_rate(df, protos.limit(0)).first().eer


def test_distances_of_a_product_are_those_of_differences():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(30, 8)) * 1000 + 5e4
    b = np.concatenate([a[:10], a[:10] + rng.normal(size=(10, 8)) * 1e-6, rng.normal(size=(10, 8))])
    plain = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert np.allclose(P._distances(a, b), plain, rtol=1e-11, atol=1e-12) and (np.diag(P._distances(a, a)) == 0).all()


def test_named_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.4), (2, 2, 0.8), (2, 2, 0.7)], "label int, predicted int, probability double")
    got = {r.metric: r.value for r in M.compute(df, ["eer", "accuracy", "error_rate"]).collect()}
    assert got == {"eer": 0.0, "accuracy": 0.75, "error_rate": 0.25}
    with pytest.raises(ValueError, match="none of"):
        M.compute(df, ["speed"])


def test_pairs_of_channels(spark):
    rows = [(s, i, float(i % 3), float(i * s % 5), float(i % 7)) for s in (1, 2) for i in range(12)]
    df = spark.createDataFrame(rows, "session long, i long, x double, y double, z double")
    stacked = S.savgol_2d_pairs(df, ["x", "y", "z"], 5, 2, "both", [("z", "x"), ("x", "y"), ("z", "x")])
    assert stacked.columns[2:] == [f"p{k}_{c}_{e}" for k, pair in enumerate(("zx", "xy", "zx")) for e in ("column", "row") for c in pair]
    alone = {(r.session, r.i): r for r in S.savgol_2d(df, "z", "x", 5, 2, "row").collect()}
    for r in stacked.collect():
        assert (r.p0_z_row, r.p2_x_row) == pytest.approx((alone[r.session, r.i].z, alone[r.session, r.i].x))
    for pairs in ([("x", "q")], [], [("x",)]):
        with pytest.raises(ValueError, match="pairs of the channels"):
            S.savgol_2d_pairs(df, ["x", "y"], 5, 2, "none", pairs)


def test_interpolation_methods(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([None, 1.0, None, None, None, 5.0, None])], "session long, i long, x double")
    got = lambda m: [r.x for r in S.interpolate(df, ["x"], m).orderBy("i").collect()]
    assert got("linear") == [1, 2, 3, 4, 5, 5] and got("previous") == [1, 1, 1, 1, 5, 5]
    assert got("next") == [1, 1, 5, 5, 5, 5, 5] and got("nearest") == [1, 1, 1, 1, 5, 5, 5]
    with pytest.raises(ValueError, match="none of"):
        S.interpolate(df, ["x"], "cubic")


def test_time_based_split_takes_late_users_for_the_test_only(spark):
    day = "timestamp'2020-01-01' + make_interval(0, 0, 0, {})"
    rows = spark.range(60).selectExpr("id % 20 user_id", "id div 20 nth").withColumn("ts", F.expr(day.format("cast(nth * user_id as int)")))
    got = T.time_based_split(rows, {"train": 0.5, "test": 0.4, "validation": 0.1}, "20 days", 3)
    users = {}
    for r in got.collect():
        users.setdefault(r.user_id, set()).add((r.split, r.role))
    tested = {u for u, s in users.items() if any(x[0] == "test" for x in s)}
    assert len(tested) == 8 and all(u >= 10 for u in tested) and len(users) == 20  # two records of user u are up to 2u days apart
    assert all(users[u] == {("test", "template"), ("test", "authentication")} for u in tested)
    assert all(len(s) == 1 and next(iter(s))[1] is None for u, s in users.items() if u not in tested)
    with pytest.raises(ValueError, match="none of"):
        T.time_based_split(rows, {"train": 1.0}, "1 day", 3)


def test_targets_and_weights_to_start_from(spark):
    indexed = spark.createDataFrame([("a", 0), ("b", 1)], "name string, idx long")
    asked = spark.createDataFrame([("b",), ("q",), (None,)], "target string")
    assert {(r.target, r.constructed.id, r.constructed.name) for r in T.construct(asked, indexed).collect()} == {("b", 1, "b"), ("q", None, "q"), (None, None, None)}
    with pytest.raises(TypeError, match="id or a name"):
        T.construct(spark.createDataFrame([(1.5,)], "target double"), indexed)
    w = np.array([r.w for r in L.initial_weights(spark, 40, 60, "embedding", 1).collect()])
    assert abs(w.mean()) < 0.1 and 0.9 < w.std() < 1.1
    u = np.array([r.w for r in L.initial_weights(spark, 40, 60, "linear", 1).collect()])
    assert abs(u).max() <= (6 / 100) ** 0.5 and abs(u.mean()) < 0.01
    with pytest.raises(ValueError, match="neither"):
        L.initial_weights(spark, 1, 1, "random")


def test_callers_functions_of_a_dataset(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 1.0)
    got = PL.dataset(df, [lambda d: d.where("id > 3"), lambda d: d.limit(100)], {"x": lambda c: -c})
    assert sorted(r.x for r in got.collect()) == [-float(i) for i in range(9, 3, -1)] and PL.dataset(df).count() == 10


def shuffled(spark, use):
    """use(), and how many rows its stages have written to shuffles."""
    context, gateway = spark.sparkContext, spark.sparkContext._gateway

    def written():
        context._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        nothing = gateway.jvm.java.util.ArrayList()
        stages = context._jsc.sc().statusStore().stageList(nothing, False, False, gateway.new_array(gateway.jvm.double, 0), nothing)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = written()
    out = use()
    return out, sum(n for k, n in written().items() if k not in before)


def plain_rate(x, y, protos, digits):
    """Equal error rate of all scores in memory, as metrics.eer() says."""
    scores = np.rint(-np.linalg.norm(x[:, None] - protos[None], axis=2) * 10**digits).ravel()
    same = (y[:, None] == np.arange(len(protos))[None]).ravel()
    at = np.unique(scores)
    fmr = 1 - np.searchsorted(np.sort(scores[~same]), at, "left") / (~same).sum()
    fnmr = np.searchsorted(np.sort(scores[same]), at, "left") / same.sum()
    k = int(np.argmax(fmr <= fnmr))
    best = k - 1 if k and fmr[k] != fnmr[k] and fmr[k - 1] + fnmr[k - 1] <= fmr[k] + fnmr[k] else k
    return at[best] / 10**digits, *sorted((fmr[best], fnmr[best]))


def test_verification_shuffles_vectors_and_not_their_pairs(spark, monkeypatch):
    """the rows that are moved grow with the vectors, and not with the blocks that each one meets."""
    monkeypatch.setattr(P, "BLOCK", 16)
    rng = np.random.default_rng(11)
    y = np.repeat(np.arange(250), 3)
    x = (rng.normal(size=(250, 4))[y] + rng.normal(size=(750, 4))).round(2)
    df = spark.createDataFrame([(i, int(y[i]), v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    got, rows = shuffled(spark, lambda: PL.verify(df, 1).first())
    query = np.arange(750) % 3 > 0
    assert (got.threshold, got.low, got.high) == pytest.approx(plain_rate(x[query], y[query], x[~query], 12), abs=1e-12)
    assert rows < 40_000  # four rounds move some thousand bins each; 500 queries and 250 prototypes in all of 16 and 32 blocks were 16,000 rows a round more


def test_scores_of_equal_vectors_are_counted_for_each(spark):
    """Vectors that are there several times, under several labels, in blocks of many tiles; against all scores in memory."""
    rng = np.random.default_rng(12)
    base, protos = rng.normal(size=(180, 3)).round(1), rng.normal(size=(20, 3)).round(1)
    protos[10:] = protos[:10]
    of = rng.integers(0, 180, 900)
    x, y = base[of], rng.integers(0, 20, 900)
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(y, x, strict=True)], "label int, embedding array<double>")
    named = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(protos)], "label long, prototype array<double>")
    got = P.equal_error_rate(df, named, 9).first()
    assert (got.threshold, got.low, got.high) == pytest.approx(plain_rate(x, y, protos, 9), abs=1e-12)
    found = {(r.genuine): (r.n, r.s) for r in P.claims(df, named, 9).groupBy("genuine").agg(F.sum("n").alias("n"), F.sum(F.col("score") * F.col("n")).alias("s")).collect()}
    every, same = -np.linalg.norm(x[:, None] - protos[None], axis=2), y[:, None] == np.arange(20)
    assert all(found[k] == (those.sum(), pytest.approx(every[those].sum())) for k, those in ((True, same), (False, ~same)))


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_matches_of_labels_come_in_parts(monkeypatch, most):
    monkeypatch.setattr(P, "MATCHES", most)
    rng = np.random.default_rng(13)
    labels = [[None if v == 4 else int(v) for v in rng.integers(0, 5, n)] for n in (30, 12)]
    times = [np.full(15, 2), np.full(4, 3)]
    x, y = (P.Block(i, np.zeros((len(t), 1)), t, {"label": P.pa.array(v)}) for i, (t, v) in enumerate(zip(times, labels, strict=True)))
    want = np.zeros((15, 4))
    for i, a in enumerate(labels[0]):
        for j, b in enumerate(labels[1]):
            want[i // 2, j // 3] += a is not None and a == b
    got, matches = np.zeros((15, 4)), P._Matches(x, y)
    for first in range(0, 15, 4):
        for i, j, n in matches.of(first, 4):
            np.add.at(got, (first + i, j), n)
    assert (got == want).all()


@pytest.fixture(scope="module")
def oracle():
    return connect(SMALL)


def test_end_to_end_verification_shuffles_no_copies_of_vectors(spark, monkeypatch, oracle):
    """in small blocks it is the row of SQL, and moves little more rows than in one block."""
    rows = {}
    for block in (512, 2):
        monkeypatch.setattr(P, "BLOCK", block)
        got, rows[block] = shuffled(spark, lambda: spark_rows(C.queries()["end_to_end_verification"](spark, SMALL)))
        assert got == sql_rows(oracle, C.oracle_sql()["end_to_end_verification"])
    assert rows[2] < rows[512] + 500


def test_verification_pairs_shuffles_no_copies_of_vectors(spark, monkeypatch, oracle):
    """the same of the sums over all pairs of a set."""
    monkeypatch.setattr(P, "BLOCK", 16)
    got, rows = shuffled(spark, lambda: spark_rows(C.queries()["verification_pairs"](spark, SMALL)))
    assert got == sql_rows(oracle, C.oracle_sql()["verification_pairs"])
    assert rows < 1_000  # 500 vectors in all of 32 blocks were 16,500 rows


@pytest.mark.parametrize("block", [2048, 7])
def test_sums_of_pairs_are_those_of_the_pairs(spark, monkeypatch, block):
    """Also with equal vectors, values that are no numbers, and labels and keys that are null or there twice."""
    monkeypatch.setattr(P, "BLOCK", block)
    rng = np.random.default_rng(14)
    x = rng.normal(size=(300, 3)).round(1)
    rows = [(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(rng.integers(0, 6, 300), x, strict=True))]
    odd = [(None, 1, [0.0, 0.0, 0.0]), (5, 2, [1.0, 0.0, 0.0]), (5, None, [1.0, 2.0, 0.0]), (300, None, [0.0, 0.0, 0.0]), (301, 3, [float("nan"), 0.0, 0.0])]
    for some in (rows, rows + odd[:-1], rows + odd, rows[:1], [], [(i, i, v) for i, _, v in rows], [(i, 1, v) for i, _, v in rows[:60]]):
        want, plain = {}, [r for r in some if r[0] is not None]
        for n, (a, k, v) in enumerate(plain):
            for b, other, w in plain[n + 1 :]:
                if a != b:
                    want.setdefault(None if k is None or other is None else k == other, []).append(-float(np.linalg.norm(np.subtract(v, w))))
        df = spark.createDataFrame(some, "vec_id long, label int, embedding array<double>")
        got = {r.genuine: r for r in P.pair_statistics(df).collect()}
        assert got.keys() == want.keys()
        for kind, scores in want.items():
            r, good = got[kind], [s for s in scores if s == s]
            assert (r.pairs, r.least) == (len(scores), pytest.approx(min(good, default=float("nan")), nan_ok=True))
            assert (r.mean, r.most) == (pytest.approx(np.mean(scores), nan_ok=True), pytest.approx(max(scores) if len(good) == len(scores) else float("nan"), nan_ok=True))
