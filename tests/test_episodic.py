import numpy as np
import pytest
from ocuspark.functions.parameters import ModelConfig
from ocuspark.operators import prototypes as P
from ocuspark.operators.embedder import ConvBlock, Embedder, EmbedderConfig, embed
from ocuspark.operators.episodic import AdamW, episode_gradient, recorded, train
from ocuspark.plans import pipelines as PL
from pyspark.sql import functions as F

CONFIG = EmbedderConfig([ConvBlock(2, 4, 3, 2, 1, gate=True, norm=True, activation="tanh"), ConvBlock(4, 3, 2, pool=2, activation="sigmoid")], [(5, "relu"), (3, "none")])


def test_gradients_equal_differences():
    rng = np.random.default_rng(4)
    net = Embedder(CONFIG, 19, seed=2)
    for k in net.weights:
        net.weights[k] = net.weights[k] + rng.normal(0, 0.1, net.weights[k].shape) ** (2 if k.endswith("var") else 1)
    x, label = rng.normal(size=(12, 2, 19)), np.arange(12) % 3
    support = np.arange(12) < 6
    assert np.allclose(recorded(net, x)[0], net.forward(x))
    _, _, grads = episode_gradient(net, x, label, support)
    assert set(grads) == {k for k in net.weights if not k.endswith(("_mean", "_var"))}
    for name, grad in grads.items():
        for at in list(np.ndindex(grad.shape))[::3]:
            old, two = net.weights[name][at], []
            for move in (1e-5, -1e-5):
                net.weights[name][at] = old + move
                two.append(episode_gradient(net, x, label, support)[0])
            net.weights[name][at] = old
            assert abs((two[0] - two[1]) / 2e-5 - grad[at]) < 1e-6, (name, at)


def test_loss_is_that_of_the_score(spark):
    rng = np.random.default_rng(5)
    net, x, label = Embedder(CONFIG, 19), rng.normal(size=(12, 2, 19)), np.arange(12) % 3
    support = np.arange(12) < 6
    loss, correct, _ = episode_gradient(net, x, label, support)
    z = net.forward(x)
    df = spark.createDataFrame([(i, int(label[i]), z[i].tolist()) for i in range(12)], "vec_id long, label int, embedding array<double>")
    row = P.score(df, 2).first()
    assert abs(row["loss"] - loss) < 1e-9 and row["accuracy"] == correct / 6


def _waves(spark, n=60):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n):
        label = i % 3
        wave = np.sin(np.arange(16) * (0.4 + 0.5 * label) + rng.uniform(0, 6)) + rng.normal(0, 0.2, 16)
        rows.append((i, label, wave.tolist()))
    return spark.createDataFrame([*rows, (900, 1, [1.0]), (901, 1, [None] * 16), (902, None, [0.0] * 16), (903, 2, None)], "guid long, label int, data array<double>")


def test_training_lowers_the_loss_and_repeats(spark):
    samples = _waves(spark)
    start = Embedder(EmbedderConfig([ConvBlock(1, 8, 5)], [(8, "none")]), 16, seed=1)
    before = {k: v.copy() for k, v in start.weights.items()}
    config = ModelConfig(n_support=4, n_query=4, iterations=48, n_classes=3, learning_rate=0.02)
    one = train(samples, start, config, per_step=4, seed=3, every=100)
    assert len(one.history) == 12
    losses = [loss for _, loss, _ in one.history]
    assert np.mean(losses[-3:]) < 0.6 * np.mean(losses[:3])
    assert all((start.weights[k] == before[k]).all() for k in before)
    two = train(samples.repartition(5), start, config, per_step=4, seed=3, every=100)
    assert all(np.allclose(one.model.weights[k], two.model.weights[k], rtol=0, atol=1e-12) for k in before)
    with pytest.raises(ValueError):
        train(samples, start, ModelConfig(optimizer="none"))


def test_no_samples_leave_the_model(spark):
    start = Embedder(EmbedderConfig([ConvBlock(1, 2, 3)]), 16)
    done = train(_waves(spark).limit(0), start, ModelConfig(iterations=2), per_step=1)
    assert done.history == [] and all((done.model.weights[k] == start.weights[k]).all() for k in start.weights)


def test_rate_falls_by_steps():
    opt, w = AdamW(0.1, 0.0, every=1, gamma=0.5), {"a": np.array([0.0]), "b": np.array([7.0])}
    first = opt.step(w, {"a": np.array([3.0])})
    second = opt.step(first, {"a": np.array([3.0])})
    assert np.allclose(first["a"], -0.1) and np.allclose(second["a"] - first["a"], -0.05) and second["b"] == 7.0


def test_predictions_return_onto_samples(spark):
    samples = _waves(spark)
    model = Embedder(EmbedderConfig([ConvBlock(1, 4, 3)], [(4, "none")]), 16)
    support = embed(samples.where("guid < 30"), model).join(samples.select("guid", "label"), "guid").select("label", "embedding")
    indexed = spark.createDataFrame([(0, "slow"), (1, "middle")], "idx long, name string")
    got = PL.predict_onto(samples.withColumn("name", F.lit("mine")), model, support, indexed).collect()
    assert len(got) == 64 and {r["name"] for r in got} == {"mine"}
    protos = {r.label: np.array(r.prototype) for r in P.prototypes(support).collect()}
    names = {0: "slow", 1: "middle", 2: None}
    for r in got:
        if r["guid"] in (900, 901, 903):
            assert r["predicted_label"] is None
            continue
        z = model.forward(np.array(r["data"])[None])[0]
        distance = {k: np.linalg.norm(z - v) for k, v in protos.items()}
        best = min(distance, key=lambda k: (distance[k], k))
        p = r["predicted_label"]
        assert (p["id"], p["name"]) == (best, names[best]) and abs(p["distance"] - distance[best]) < 1e-9
