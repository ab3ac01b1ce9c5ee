import math

import numpy as np
import pytest
from ocuspark.functions import columns as C
from ocuspark.functions.parameters import ModelConfig, as_json, as_text, parameters
from ocuspark.operators import layers as L
from ocuspark.operators import metrics as M
from ocuspark.operators import prototypes as P
from ocuspark.operators import samples as SM
from ocuspark.operators import targets as T
from ocuspark.operators.embedder import ConvBlock, Embedder, EmbedderConfig, embed
from ocuspark.sources import files
from pyspark.sql import functions as F


def samples(spark, names, skip=()):
    return spark.createDataFrame([(i, n, n in skip, i % 3) for i, n in enumerate(names)], "pos long, name string, skip boolean, user_id long")


def test_config_index_and_lookup(spark):
    df = spark.createDataFrame([(0, "b", True), (1, "a", False), (2, "b", False), (3, "c", False), (4, "c", True), (5, None, False)], "pos long, name string, skip boolean")
    config = T.configuration(df)
    assert sorted((r.name, r.skip) for r in config.collect()) == [("a", False), ("b", False), ("c", True)]
    indexed = T.index(config)
    assert sorted((r.idx, r.name) for r in indexed.collect()) == [(0, "b"), (1, "a")]
    assert T.lookup(df.where("name in ('a', 'b')"), indexed).count() == 3
    with pytest.raises(Exception, match="no index for c"):
        T.lookup(df.where("name = 'c'"), indexed).collect()
    with pytest.raises(IndexError):
        T.at_index(indexed, [2])
    typed = config.withColumn("dataset_type", F.when(F.col("name") == "c", "test").otherwise("train"))
    got = sorted((r.dataset_type, r.idx) for r in T.by_dataset_type(typed, T.index(typed)).collect() if r.idx is not None)
    assert got == [("train", 0), ("train", 1)]
    assert sorted((r.name, r.k, r.v) for r in T.one_hot_rows(indexed).collect()) == [("a", 0, 0), ("a", 1, 1), ("b", 0, 1), ("b", 1, 0)]


def test_splits_are_disjoint_and_cover(spark):
    shares = T.proportions({"train": 6, "validation": 2, "test": 2})
    assert sum(shares.values()) == pytest.approx(1)
    names = [f"n{i}" for i in range(119)]
    df = samples(spark, names + names[:40] + names[:10])
    for split in (T.random_split(df, shares, 11), T.ordered_split(df, shares)):
        rows = split.collect()
        assert sorted(r.name for r in rows) == sorted(names)
        count = {k: sum(r.split == k for r in rows) for k in shares}
        assert count == {"train": 71, "validation": 24, "test": 24}
    ordered = {r.name: r.split for r in T.ordered_split(df, shares).collect()}
    assert all(ordered[f"n{i}"] == "train" for i in range(40))
    other = {r.name: r.split for r in T.random_split(df, shares, 12).collect()}
    assert other != {r.name: r.split for r in T.random_split(df, shares, 11).collect()}
    with pytest.raises(TypeError):
        T.split_samples(df, T.random_split(df, shares, 1).withColumn("name", F.lit(1)))


@pytest.mark.parametrize("bad", [{"a": -1, "b": 2}, {"a": 0}])
def test_bad_proportions(bad):
    with pytest.raises(ValueError):
        T.proportions(bad)


def test_few_targets_are_refused():
    with pytest.raises(ValueError):
        T.proportions({"a": 0.9, "b": 0.1}, targets=5)


def test_episodes(spark):
    items = spark.createDataFrame([(k, 100 * k + i) for k in range(4) for i in range(3 if k == 0 else 9)], "label int, item long")
    rows = T.episodes(items, 4, 5, 6, 1).collect()
    for e in range(6):
        for k in range(4):
            own = sorted((r.shot, r.item) for r in rows if r.episode == e and r.label == k)
            assert [s for s, _ in own] == [1, 2, 3, 4, 5]
            assert len({i for _, i in own}) == (3 if k == 0 else 5)
    roles = T.prototypical_episodes(items, 2, 1, 2, 3, 1).collect()
    assert len({r.label for r in roles if r.episode == 0}) == 2
    assert sum(r.role == "support" for r in roles) == 6 and sum(r.role == "query" for r in roles) == 12


def test_time_split(spark):
    df = spark.sql("select * from values (1, timestamp'2020-01-01'), (1, timestamp'2020-06-01'), (2, timestamp'2020-01-01'), (2, timestamp'2020-01-02') t(user_id, ts)")
    assert sorted(r.role for r in T.time_split(df, "90 days").collect()) == ["authentication", "template"]


def brute_eer(scores):
    g = [s for s, y in scores if y]
    m = [s for s, y in scores if not y]
    t = sorted({s for s, _ in scores})
    fmr, fnmr = [sum(x >= v for x in m) / len(m) for v in t], [sum(x < v for x in g) / len(g) for v in t]
    at = next((i for i in range(len(t)) if fmr[i] <= fnmr[i]), None)
    if at is None:
        return fmr, fnmr, (0, 1.0, 1.0, 1.0)
    pick = at if at == 0 or fmr[at] == fnmr[at] or fmr[at] + fnmr[at] < fmr[at - 1] + fnmr[at - 1] else at - 1
    low, high = sorted((fmr[pick], fnmr[pick]))
    return fmr, fnmr, (pick, low, high, (low + high) / 2)


@pytest.mark.parametrize("seed", range(5))
def test_fmr_fnmr_and_eer_equal_the_definition(spark, seed):
    rng = np.random.default_rng(seed)
    scores = [(float(round(rng.normal(1.2 * y), 1)), bool(y)) for y in rng.integers(0, 2, 120)]
    curves = M.fmr_fnmr(spark.createDataFrame(scores, "score double, genuine boolean"), 5)
    rows = sorted(curves.collect())
    fmr, fnmr, best = brute_eer(scores)
    assert [r.fmr for r in rows] == pytest.approx(fmr) and [r.fnmr for r in rows] == pytest.approx(fnmr)
    assert fmr == sorted(fmr, reverse=True) and fnmr == sorted(fnmr)
    assert tuple(M.eer(curves).first()) == pytest.approx(best)


def test_eer_that_never_crosses_and_no_impostors(spark):
    never = spark.createDataFrame([(0.1, 0.9, 0.1), (0.2, 0.8, 0.2)], "threshold double, fmr double, fnmr double")
    assert tuple(M.eer(never).first()) == (0, 1.0, 1.0, 1.0)
    lonely = M.fmr_fnmr(spark.createDataFrame([(0.5, True), (None, True)], "score double, genuine boolean"), 2).collect()
    assert [(r.fmr, r.fnmr) for r in lonely] == [(None, 0.0)]


def test_prototypes(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 5)), rng.integers(0, 3, 40)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(40)], "vec_id long, embedding array<double>, label int")
    means = np.stack([x[y == k].mean(axis=0) for k in range(3)])
    d = np.linalg.norm(x[:, None] - means[None], axis=2)
    p = np.exp(-d) / np.exp(-d).sum(axis=1, keepdims=True)
    got = {r.vec_id: (r.predicted, r.probability) for r in P.predict(P.distances(df, P.prototypes(df))).collect()}
    for i in range(40):
        assert got[i][0] == d[i].argmin() and got[i][1] == pytest.approx(p[i].max())
    with pytest.raises(Exception, match="differ in size"):
        P.distances(df, spark.createDataFrame([(0, [1.0])], "label int, prototype array<double>")).collect()
    s = P.score(df, 4).first()
    assert s.queries == 40 - 12 and 0 <= s.accuracy <= 1 and s.loss > 0


def test_embedder_equals_layers(spark):
    config = EmbedderConfig([ConvBlock(2, 3, 3, 2, gate=True), ConvBlock(3, 4, 3, pool=2, norm=True)], [(5, "tanh"), (3, "none")])
    assert EmbedderConfig.from_json(config.to_json()) == config
    net = Embedder(config, 20)
    x = np.random.default_rng(0).normal(size=(2, 2, 20))
    assert net.forward(x).shape == (2, 3) and np.allclose(net.forward(x[..., None]), net.forward(x))
    df = spark.createDataFrame([(i, x[i].ravel().tolist()) for i in range(2)] + [(2, None), (3, [1.0])], "guid long, data array<double>")
    got = {r.guid: r.embedding for r in embed(df, net).collect()}
    assert np.allclose([got[0], got[1]], net.forward(x)) and got[2] is None and got[3] is None
    long = spark.createDataFrame([(b, c, t, float(x[b, c, t])) for b in range(2) for c in range(2) for t in range(20)], "id int, c int, t long, v double")
    w = net.weights["conv0"]
    weights = spark.createDataFrame([(o, c, k, float(w[o, c, k])) for o in range(3) for c in range(2) for k in range(3)], "o int, c int, k int, w double")
    conv = {(r.id, r.o, r.t): r.v for r in L.conv1d(long, weights, 3, 2).collect()}
    first = np.einsum("bctk,ock->bot", np.lib.stride_tricks.sliding_window_view(x, 3, axis=2)[:, :, ::2], w)
    assert all(conv[i] == pytest.approx(first[i]) for i in np.ndindex(first.shape)) and len(conv) == first.size


def test_weights_and_parameters(spark, tmp_path):
    net = Embedder(EmbedderConfig([ConvBlock(1, 2)]), 8)
    files.save_weights(spark, net.weights, f"{tmp_path}/w")
    again = files.load_weights(spark, f"{tmp_path}/w")
    assert all(np.allclose(again[k], v) for k, v in net.weights.items())
    assert parameters(ModelConfig())["n_support"] == 10 and "n_query=10" in as_text(ModelConfig()) and '"iterations": 100' in as_json(ModelConfig())


def test_samples_in_files(spark, tmp_path):
    schema = SM.sample_schema()
    rows = [{"guid": i, "seq_id": 1, "session_id": 2, "user_id": i, "data": [[1.0, None], [2.0, 3.0]], "data_type": "raw", "attributes": {"k": "é"}, "skip_sample": False} for i in range(12)]
    df = spark.createDataFrame(rows, schema).withColumn("pos", F.col("guid"))
    for fmt in files.FORMATS:
        for single in (True, False):
            path = f"{tmp_path}/{fmt}{single}"
            files.save_samples(df, path, fmt, single, 11)
            got = files.load_samples(spark, path, fmt, n_samples=10).collect()
            assert [r.guid for r in got] == list(range(10)) and got[0].data == [[1.0, None], [2.0, 3.0]] and got[0].attributes == {"k": "é"}
    with pytest.raises(ValueError):
        files.load_samples(spark, f"{tmp_path}/none")
    assert SM.distinct_by_identity(SM.union(df, df)).count() == 12
    with pytest.raises(ValueError):
        SM.not_empty(df.limit(0))


def test_targets_and_recordings_in_files(spark, tmp_path):
    config = spark.createDataFrame([("Zoë", False, "train", 0), ("b", True, "test", 1), ("a", False, "test", 2)], "name string, skip boolean, dataset_type string, pos long")
    files.save_targets(config, f"{tmp_path}/t")
    got = [(r.pos, r.name, r.skip, r.dataset_type) for r in files.load_targets(spark, f"{tmp_path}/t").orderBy("pos").collect()]
    assert got == [(0, "Zoë", False, "train"), (1, "b", True, "test"), (2, "a", False, "test")]
    (tmp_path / "r.csv").write_text("x,label\n1.5,cat:big\n2.5,\n3.5,dog\n")
    schema = spark.createDataFrame([], "x double, label string").schema
    rows = files.read_recordings_csv(spark, f"{tmp_path}/r.csv", schema, "label").collect()
    assert [(r.x, r.target.name, r.target.subtype) for r in rows] == [(1.5, "cat", "big"), (3.5, "dog", None)]


def test_labels_and_types(spark):
    df = spark.sql("select struct(array('a','b') as labels, map('a', 0.2D, 'b', 0.8D) as probabilities, array(1D, 2D) as distances) l, struct(array('b') as labels, map('b', 0.1D) as probabilities, array(1D) as distances) r")
    m = df.select(C.merge_labels(F.col("l"), F.col("r")).alias("m")).first().m
    assert m.labels == ["a", "b"] and m.probabilities == {"a": 0.2, "b": 0.1} and m.distances is None
    t = SM.narrow_types(spark.sql("select * from values (1L, 300L, 1.5D, 127L), (2L, -5L, 2.5D, 1L) t(a, b, c, d)"))
    assert t == {"a": "tinyint", "b": "smallint", "c": "float", "d": "smallint"}
    z = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0)], "id int, o int, v double")
    assert {r.o: r.p for r in L.softmax(z).collect()}[1] == pytest.approx(math.exp(3) / (math.exp(1) + math.exp(3)))


def test_trained_head_and_pipelines(spark, tmp_path):
    from ocuspark.operators.training import fit_linear_head
    from ocuspark.plans import pipelines as PL

    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 90)
    x = rng.normal(size=(90, 4)) + 4 * np.eye(4)[y]
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(90)], "vec_id long, embedding array<double>, label int")
    weights = spark.createDataFrame([(k, 1.0) for k in range(3)], "label int, weight double")
    for head in (fit_linear_head(df), fit_linear_head(df, class_weights=weights)):
        got = {r.id: r.predicted for r in head.predict(df).collect()}
        assert np.mean([got[i] == y[i] for i in range(90)]) > 0.95
    assert PL.verify(df, 5).first().eer < 0.15
    data = samples(spark, ["a", "b", "c", "d", "e"] * 4)
    made = PL.generate_targets(data, {"train": 3, "test": 2}, path=f"{tmp_path}/config")
    again = files.load_targets(spark, f"{tmp_path}/config")
    assert {(r.name, r.dataset_type) for r in made.collect()} == {(r.name, r.dataset_type) for r in again.collect()}
    with pytest.raises(ValueError):
        PL.generate_targets(data, {"train": 1}, scheme="by hand")


def test_schema_check_and_old_logs(spark, tmp_path):
    from ocuspark.functions.parameters import clear_logs
    from ocuspark.operators.samples import check_schema
    from pyspark.sql import types as T

    df = spark.range(1).selectExpr("id", "cast(id as string) as name", "1 as more")
    assert check_schema(df, T.StructType.fromDDL("id bigint, name string")) is df
    with pytest.raises(TypeError, match="name: string, not int; gone: missing, not double"):
        check_schema(df, T.StructType.fromDDL("name int, gone double"))
    (tmp_path / "below.log").mkdir()
    for name in ("b.log", "a.log", "a.txt"):
        (tmp_path / name).write_text("")
    assert clear_logs(str(tmp_path)) == ["a.log", "b.log"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.txt", "below.log"]
    with pytest.raises(FileNotFoundError):
        clear_logs(str(tmp_path / "none"))
