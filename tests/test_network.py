"""The network's layers against plain loops, its gradients against differences, its readers, and stored prototypes."""

import json

import numpy as np
import pytest
from ocuspark.operators import prototypes as P
from ocuspark.operators.embedder import ConvBlock, Embedder, EmbedderConfig, embed
from ocuspark.operators.episodic import episode_gradient
from ocuspark.operators.network import ACTIVATIONS, GATE_POOLS, Run, follow, merged
from ocuspark.plans.learning import CONFIG, two_blocks

from .test_episodic import _waves

ODD = EmbedderConfig(
    [
        ConvBlock(2, 4, 3, 2, 1, dilation=2, gate=True, gate_pools=("lse", "lp", "avg", "max"), spatial=3, pool=5, pool_stride=2, norm=True, activation="elu"),
        ConvBlock(4, 3, 2, pool=3, pool_stride=1, pool_padding=1, pool_kind="avg", norm=True, activation="leaky_relu"),
        ConvBlock(3, 3, 1, spatial=3, pool=2, pool_stride=3, pool_kind="lp", activation="sigmoid"),
    ],
    [(6, "relu", 0.3, 0.2), (3, "none", 0.25)],
)


def _net(seed=2, config=ODD, length=41):
    rng, net = np.random.default_rng(seed), Embedder(config, length, seed=seed)
    for k in net.weights:
        net.weights[k] = net.weights[k] + rng.normal(0, 0.1, net.weights[k].shape) ** (2 if k.endswith("var") else 1)
    return net


def _plain(net, x):
    """One value after the other, as in use."""
    w, sig = net.weights, lambda v: 1 / (1 + np.exp(-v))
    for i, b in enumerate(net.config.conv):
        x = np.pad(x, ((0, 0), (b.padding, b.padding)))
        n = (x.shape[1] - (b.kernel - 1) * b.dilation - 1) // b.stride + 1
        x = np.array([[w[f"conv{i}_bias"][o] + sum(x[c, t * b.stride + k * b.dilation] * w[f"conv{i}"][o, c, k] for c in range(b.in_channels) for k in range(b.kernel)) for t in range(n)] for o in range(b.out_channels)])
        if b.gate:
            pools = {"avg": x.mean(1), "max": x.max(1), "lp": np.sqrt((x**2).sum(1)), "lse": np.log(np.exp(x).sum(1))}
            total = 0
            for kind in b.gate_pools:
                hidden = np.maximum(w[f"gate{i}_in"] @ pools[kind] + w[f"gate{i}_in_bias"], 0)
                total = total + w[f"gate{i}_out"] @ hidden + w[f"gate{i}_out_bias"]
            x = x * sig(total)[:, None]
        if b.spatial:
            both, h = np.pad(np.stack([x.max(0), x.mean(0)]), ((0, 0), (b.spatial // 2, b.spatial // 2))), f"spatial{i}_norm"
            g = np.array([sum(both[c, t + k] * w[f"spatial{i}"][0, c, k] for c in (0, 1) for k in range(b.spatial)) for t in range(x.shape[1])])
            x = x * sig((g - w[f"{h}_mean"]) / np.sqrt(w[f"{h}_var"] + 1e-5) * w[f"{h}_gamma"] + w[f"{h}_beta"])
        if b.pool > 1:
            x = np.pad(x, ((0, 0), (b.pool_padding, b.pool_padding)), constant_values=-np.inf if b.pool_kind == "max" else 0)
            step = b.pool_stride or b.pool
            f = {"max": np.max, "avg": np.mean, "lp": lambda v: np.sqrt((v**2).sum())}[b.pool_kind]
            x = np.array([[f(x[c, t * step : t * step + b.pool]) for t in range((x.shape[1] - b.pool) // step + 1)] for c in range(len(x))])
        if b.norm:
            h = f"norm{i}"
            x = (x - w[f"{h}_mean"][:, None]) / np.sqrt(w[f"{h}_var"] + 1e-5)[:, None] * w[f"{h}_gamma"][:, None] + w[f"{h}_beta"][:, None]
        x = ACTIVATIONS[b.activation](x)[0]
    x = x.ravel()
    for i, (_, activation, *_) in enumerate(net.config.fc):
        x = ACTIVATIONS[activation](w[f"fc{i}"] @ x + w[f"fc{i}_bias"])[0]
    return x


@pytest.mark.parametrize(("config", "length"), [(ODD, 41), (CONFIG, 64)])
def test_forward_equals_plain_loops(config, length):
    net = _net(config=config, length=length)
    x = np.random.default_rng(1).normal(size=(5, config.conv[0].in_channels, length))
    assert np.allclose(net.forward(x), [_plain(net, one) for one in x], rtol=0, atol=1e-12)


@pytest.mark.parametrize("training", [False, True])
def test_gradients_equal_differences(training):
    """In training: through the batch's own moments and the dropped units."""
    net, rng = _net(), np.random.default_rng(4)
    x, label = rng.normal(size=(12, 2, 41)), np.arange(12) % 3
    support, keys = np.arange(12) < 6, np.arange(12).astype(np.uint64)
    value = lambda: episode_gradient(net, x, label, support, Run(net.weights, training, keys, (3, 1)))
    grads = value()[2]
    assert set(grads) == {k for k in net.weights if not k.endswith(("_mean", "_var"))}
    for name, grad in grads.items():
        for at in list(np.ndindex(grad.shape))[:: max(1, grad.size // 7)]:
            old, two = net.weights[name][at], []
            for move in (1e-5, -1e-5):
                net.weights[name][at] = old + move
                two.append(value()[0])
            net.weights[name][at] = old
            assert abs((two[0] - two[1]) / 2e-5 - grad[at]) < 1e-6, (name, at)


@pytest.mark.parametrize("kind", [*GATE_POOLS])
def test_each_kind_of_gate(kind):
    config = EmbedderConfig([ConvBlock(1, 3, 2, gate=True, gate_pools=(kind,), activation="tanh")], [])
    net, x = _net(config=config, length=7), np.random.default_rng(2).normal(size=(6, 1, 7))
    label, support = np.arange(6) % 2, np.arange(6) < 3
    grad = episode_gradient(net, x, label, support)[2]["conv0"]
    for at in np.ndindex(grad.shape):
        old, two = net.weights["conv0"][at], []
        for move in (1e-5, -1e-5):
            net.weights["conv0"][at] = old + move
            two.append(episode_gradient(net, x, label, support)[0])
        net.weights["conv0"][at] = old
        assert abs((two[0] - two[1]) / 2e-5 - grad[at]) < 1e-6


def test_merged_moments_are_those_of_all_rows():
    x = np.random.default_rng(3).normal(5, 3, (40, 6, 9))
    w = {"a_gamma": np.ones(6), "a_beta": np.zeros(6), "a_mean": np.zeros(6), "a_var": np.ones(6)}

    def moments(part):
        run = Run(w, True)
        run.normalise(part, "a")
        return run.moments["a"]

    whole, parts = moments(x), [moments(p) for p in np.split(x, (1, 7, 30))]
    for order in ((0, 1, 2, 3), (3, 1, 0, 2)):
        assert np.allclose(merged([parts[i] for i in order]), whole, rtol=1e-12, atol=1e-12)
    assert np.allclose(whole, np.concatenate([[360], x.mean(axis=(0, 2)), x.var(axis=(0, 2)) * 360]), rtol=1e-12)
    after = follow(w, {"a": whole}, lambda _: 0.1)
    assert np.allclose(after["a_mean"], 0.1 * x.mean(axis=(0, 2))) and np.allclose(after["a_var"], 0.9 + 0.1 * x.var(axis=(0, 2), ddof=1))


def test_dropout_is_drawn_from_what_it_is_told():
    keys = np.arange(3000).astype(np.uint64)
    drop = lambda draw, layer, training=True, keys=keys: Run({}, training, keys, draw).dropout(np.ones((len(keys), 20)), 0.3, layer)[0]
    one = drop((7, 2, 5), 1)
    assert (one == drop((7, 2, 5), 1)).all() and set(np.unique(one).round(9)) == {0, round(1 / 0.7, 9)}
    assert abs((one == 0).mean() - 0.3) < 0.01 and (np.abs((one == 0).mean(axis=0) - 0.3) < 0.05).all()
    for other in (drop((7, 3, 5), 1), drop((8, 2, 5), 1), drop((7, 2, 6), 1), drop((7, 2, 5), 2), drop((7, 2, 5), 1, keys=keys + np.uint64(3000))):
        assert abs((one == other).mean() - (0.7**2 + 0.3**2)) < 0.02
    assert (drop((7, 2, 5), 1, keys=keys[::-1]) == one[::-1]).all()
    assert (drop((7, 2, 5), 1, training=False) == 1).all()


def _layers(channels, sizes, fc, **more):
    """JSON of blocks like those of studies: kernel 3, stride 2, a channel gate, an overlapping pool, a normalisation."""
    blocks = []
    for (a, b), pool in zip(zip(channels, channels[1:], strict=False), sizes, strict=True):
        blocks.append({
            "conv": {"in_channels": a, "out_channels": b, "kernel_size": 3, "stride": 2, "dilation": 1}, "cbam": {"gate_channels": b, "reduction_ratio": 16, "no_spatial": True},
            "pool_type": "MaxPool1d", "pool": {"kernel_size": pool, "stride": 2, "padding": 0}, "norm_type": "BatchNorm1d", "norm": {"num_features": b}, "activation_type": "ReLU", "activation": {"inplace": True},
        } | more)
    return {"conv": blocks, "fc": fc}


def test_json_of_layers():
    fc = [{"linear": {"out_features": 512}, "dropout": {"p": 0.5}, "activation_type": "ReLU", "activation": {"inplace": True}}, {"linear": {"in_features": 512, "out_features": 128}, "dropout": {"p": 0.5}}]
    config = EmbedderConfig.from_layers(json.dumps(_layers((4, 128, 256, 256), (5, 3, 3), fc)))
    assert config.conv[0] == ConvBlock(4, 128, 3, 2, gate=True, reduction=16, pool=5, pool_stride=2, norm=True) and config.conv[2].pool == 3
    assert config.fc == [(512, "relu", 0.5), (128, "none", 0.5)]
    net = Embedder(config, 1000)
    assert net.weights["fc0"].shape == (512, 256 * 14) and net.weights["gate1_in"].shape == (16, 256)
    assert net.forward(np.random.default_rng(0).random((2, 4, 1000))).shape == (2, 128)
    again = EmbedderConfig.from_json(config.to_json())
    assert again.conv == config.conv and again.fc == config.fc
    plain = EmbedderConfig.from_layers(json.dumps(_layers((2, 6), (4,), [], cbam={"gate_channels": 6, "reduction_ratio": 2, "pool_types": ["lse"]}, pool_type="AvgPool1d", pool={"kernel_size": [4]}, norm_type=None, activation_type=None)))
    assert plain.conv[0] == ConvBlock(2, 6, 3, 2, gate=True, gate_pools=("lse",), spatial=3, pool=4, pool_kind="avg", activation="none")
    for bad in ({"pool_type": "FractionalPool"}, {"norm_type": "GroupNorm"}, {"activation_type": "Softmax"}, {"cbam": {"gate_channels": 5}}, {"norm": {"num_features": 5}}, {"pool": {"kernel_size": 4, "ceil_mode": True}}):
        with pytest.raises(ValueError):
            EmbedderConfig.from_layers(json.dumps(_layers((2, 6), (4,), [], **bad)))
    with pytest.raises(ValueError):
        EmbedderConfig.from_layers(json.dumps(_layers((2, 6), (4,), [{"linear": {"out_features": 3}}, {"linear": {"in_features": 4, "out_features": 2}}])))
    with pytest.raises(ValueError):
        Embedder(config, 20)  # shorter than the network reaches


def test_two_blocks_in_spark(spark):
    net = two_blocks()
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(9).normal(size=(7, 64)))]
    got = {r.guid: r.embedding for r in embed(spark.createDataFrame([*rows, (99, None), (98, [1.0])], "guid long, data array<double>"), net).collect()}
    assert got[99] is None and got[98] is None
    assert all(np.allclose(got[i], _plain(net, np.array(v)[None]), rtol=0, atol=1e-12) for i, v in rows)


def test_store(spark, tmp_path):
    """Batches in any order equal one pass; nulls are left out; versions follow each other; cold, hot and neither."""
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 4), rng.normal(size=6).tolist()) for i in range(80)] + [(90, None, [1.0] * 6), (91, 1, None), (92, 1, [None] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = {k: np.mean([v for _, c, v in rows[:80] if c == k], axis=0) for k in range(4)}
    for name, order in (("a", (0, 1, 2)), ("b", (2, 0, 1))):
        store = P.Store(spark, f"{tmp_path}/{name}")
        with pytest.raises(ValueError):
            P.chosen(None, store)
        for part in order:
            store.update(df.where(f"vec_id % 3 = {part}"))
        got = {r.label: r for r in store.prototypes().collect()}
        assert got.keys() == want.keys() and len(store.versions()) == 3
        assert all(np.allclose(got[k].prototype, want[k], rtol=0, atol=1e-12) and got[k].n == 20 for k in want)
    store.update(df.limit(0))
    assert {r.label for r in store.prototypes().collect()} == set(want)
    (tmp_path / "b" / "version-000000009").mkdir()  # a writer that was lost
    assert len(store.versions()) == 4
    good = df.where("vec_id < 80")
    cold = {r.vec_id: r.predicted for r in P.predict_with(good, store=store).collect()}
    hot = {r.vec_id: r.predicted for r in P.predict_with(good, support=good.where("label < 2"), store=store).collect()}
    for i, _, v in rows[:80]:
        assert cold[i] == min(want, key=lambda k: np.linalg.norm(want[k] - v)) and hot[i] in (0, 1)
    with pytest.raises(ValueError):
        P.predict_with(good)
    with pytest.raises(Exception, match="differ in size"):
        P.sums(spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "label int, embedding array<double>")).collect()
