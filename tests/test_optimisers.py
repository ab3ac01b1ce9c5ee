import json
import math

import numpy as np
import pytest
from ocuspark.functions.parameters import ModelConfig
from ocuspark.operators import episodic as E
from ocuspark.operators import layers as L
from ocuspark.operators.embedder import ConvBlock, Embedder, EmbedderConfig
from ocuspark.operators.optimisers import Optimiser

from .test_episodic import _waves

OPTIONS = {
    "SGD": [{}, {"momentum": 0.9}, {"momentum": 0.8, "dampening": 0.1}, {"momentum": 0.9, "nesterov": True}],
    "RMSprop": [{}, {"alpha": 0.9, "momentum": 0.5}, {"centered": True}], "Adam": [{}, {"betas": (0.8, 0.99)}], "AdamW": [{"eps": 1e-6}], "Adagrad": [{"lr_decay": 0.1}],
}


def plain(rule, o, w, grads, rate, decay):
    """One number, step by step, by the optimisers' published formulas."""
    speed = square = mean = first = second = 0.0
    for t, g in enumerate(grads, 1):
        g += decay * w if rule != "AdamW" else 0
        if rule == "SGD":
            mu = o.get("momentum", 0)
            if mu:
                speed = g if t == 1 else mu * speed + (1 - o.get("dampening", 0)) * g
                g = g + mu * speed if o.get("nesterov") else speed
            w -= rate * g
        elif rule == "RMSprop":
            a = o.get("alpha", 0.99)
            square = a * square + (1 - a) * g * g
            mean = a * mean + (1 - a) * g
            under = math.sqrt(square - (mean * mean if o.get("centered") else 0)) + 1e-8
            speed = o.get("momentum", 0) * speed + g / under
            w -= rate * speed
        elif rule == "Adagrad":
            square += g * g
            w -= rate / (1 + (t - 1) * o["lr_decay"]) * g / (math.sqrt(square) + 1e-10)
        else:
            b1, b2 = o.get("betas", (0.9, 0.999))
            w -= rate * decay * w if rule == "AdamW" else 0
            first, second = b1 * first + (1 - b1) * g, b2 * second + (1 - b2) * g * g
            w -= rate * (first / (1 - b1**t)) / (math.sqrt(second / (1 - b2**t)) + o.get("eps", 1e-8))
    return w


@pytest.mark.parametrize(("rule", "options"), [(r, o) for r, all_ in OPTIONS.items() for o in all_])
def test_rules_equal_a_plain_loop(rule, options):
    rng = np.random.default_rng(1)
    start, grads = rng.normal(size=3), rng.normal(size=(9, 3))
    opt, w = Optimiser(rule, 0.05, 0.02, options), {"a": start, "b": np.array([7.0])}
    for k, g in enumerate(grads):
        if k == 4:  # taken up from its state
            arrays, numbers = opt.state()
            opt = Optimiser(rule, 0.05, 0.02, options)
            opt.restore({n: v.copy() for n, v in arrays.items()}, json.loads(json.dumps(numbers)))
        w = opt.step(w, {"a": g})
    assert np.allclose(w["a"], [plain(rule, options, start[i], grads[:, i], 0.05, 0.02) for i in range(3)], rtol=0, atol=1e-12) and w["b"] == 7


def test_schedules():
    rates = lambda n, *a: [(o.rate, o.step({"a": np.zeros(1)}, {"a": np.zeros(1)}))[0] for o in [Optimiser("SGD", 1.0, 0.0, None, *a)] for _ in range(n)]
    assert np.allclose(rates(5, "StepLR", {"step_size": 2, "gamma": 0.5}), [1, 1, 0.5, 0.5, 0.25]) and rates(2) == [1, 1]
    assert np.allclose(rates(5, "MultiStepLR", {"milestones": (1, 3), "gamma": 0.1}), [1, 0.1, 0.1, 0.01, 0.01]) and np.allclose(rates(3, "ExponentialLR", {"gamma": 0.5}), [1, 0.5, 0.25])
    assert np.allclose(rates(5, "CosineAnnealingLR", {"T_max": 4, "least": 0.2}), [0.2 + 0.4 * (1 + math.cos(math.pi * k / 4)) for k in range(5)])
    plateau = Optimiser("SGD", 1.0, schedule="ReduceLROnPlateau", schedule_options={"factor": 0.1, "patience": 1, "min_lr": 0.005})
    seen = []
    for loss in (3, 2, 2, 2, 1.9999, 1.5, 1.6, 1.6, 1.6, 1.6, 1.6, 1.6):
        plateau.told(loss)
        seen.append(round(plateau.rate, 9))
    assert seen == [1, 1, 1, 0.1, 0.1, 0.1, 0.1, 0.01, 0.01, 0.005, 0.005, 0.005]
    for bad in (("Nadam", 1.0), ("SGD", 1.0, 0.0, {"beta": 1}), ("SGD", 1.0, 0.0, {}, "Warm"), ("SGD", 1.0, 0.0, {}, "StepLR", {"T_max": 1})):
        with pytest.raises(ValueError):
            Optimiser(*bad)


def test_configuration_from_json():
    text = json.dumps({"model_name": "m", "n_support": 3, "optimizer_type": "SGD", "optimizer_kwargs": {"lr": 0.1, "weight_decay": 0.01, "momentum": 0.9}, "lr_scheduler_type": "StepLR", "lr_scheduler_kwargs": {"gamma": 0.1, "step_size": 5}})
    config = ModelConfig.from_json(text)
    assert (config.n_support, config.optimizer, config.learning_rate, config.weight_decay, config.optimizer_options, config.schedule) == (3, "SGD", 0.1, 0.01, {"momentum": 0.9}, "StepLR")
    assert E.optimiser_of(config).o == {"step_size": 5, "gamma": 0.1}
    with pytest.raises(TypeError):
        ModelConfig.from_json(json.dumps({"n_suport": 3}))


NETWORK = EmbedderConfig([ConvBlock(1, 6, 5, gate=True, spatial=3, pool=3, pool_stride=2, norm=True)], [(8, "relu", 0.2), (6, "none")])
RUN = ModelConfig(n_support=4, n_query=4, iterations=24, n_classes=3, optimizer="Adam", learning_rate=0.01, schedule="ReduceLROnPlateau", schedule_options={"patience": 0, "factor": 0.5})


def _same(a, b):
    return all((a.weights[k] == b.weights[k]).all() for k in a.weights) and a.weights.keys() == b.weights.keys()


def test_a_run_that_is_killed_and_resumed_equals_an_unbroken_one(spark, tmp_path, monkeypatch):
    samples = _waves(spark)
    start = Embedder(NETWORK, 16, seed=1)
    go = lambda path: E.train(samples, start, RUN, per_step=4, seed=3, validation=samples.where("guid % 2 = 0"), validate_every=2, validation_episodes=3, path=path, save_every=2)
    whole = go(None)
    assert [k for k, *_ in whole.validations] == [0, 2, 4, 6] and len(whole.history) == 6
    step, left = Optimiser.step, [4]

    def dies(self, *args):
        left[0] -= 1
        if left[0] < 0:
            raise KeyboardInterrupt
        return step(self, *args)

    monkeypatch.setattr(Optimiser, "step", dies)
    with pytest.raises(KeyboardInterrupt):
        go(f"{tmp_path}/run")
    left[0] = 2  # steps 0 to 3 are saved, two are to be made
    resumed = go(f"{tmp_path}/run")
    assert left[0] == 0 and resumed.history == whole.history and resumed.validations == whole.validations
    assert _same(resumed.model, whole.model) and _same(resumed.last, whole.last)
    assert go(f"{tmp_path}/run").history == whole.history and left[0] == 0  # nothing left to do
    with pytest.raises(ValueError, match="another configuration"):
        E.train(samples, start, ModelConfig(n_classes=3, n_support=4, n_query=4), path=f"{tmp_path}/run")
    # running moments have moved, and the model is that of the best loss
    assert not np.allclose(whole.last.weights["norm0_mean"], 0) and not np.allclose(whole.last.weights["spatial0_norm_var"], 1)
    assert whole.validations[-1][1] < whole.validations[0][1]


def test_the_best_state_is_kept(spark):
    samples = _waves(spark)
    start = Embedder(EmbedderConfig([ConvBlock(1, 8, 5)], [(8, "none")]), 16, seed=1)
    wild = ModelConfig(n_support=4, n_query=4, iterations=6, n_classes=3, optimizer="SGD", learning_rate=500.0, schedule="none")
    done = E.train(samples, start, wild, per_step=2, validation=samples, validate_every=1, validation_episodes=2)
    assert done.validations[0][1] == min(loss for _, loss, _ in done.validations) and _same(done.model, start) and not _same(done.last, start)


def test_moments_of_a_step_are_those_of_its_episodes_in_one_task(spark):
    """Of a first normalisation, whose input no other one has touched."""
    net = Embedder(NETWORK, 16, seed=4)
    rng = np.random.default_rng(8)
    parts, got = [rng.normal(size=(6, 1, 16)) for _ in range(3)], []
    label, support, keys = np.arange(6) % 2, np.arange(6) < 3, np.arange(6).astype(np.uint64)
    for x in parts:
        run = E.Run(net.weights, True, keys, (0,))
        grads = E.episode_gradient(net, x, label, support, run)[2]
        flat, moments = (np.concatenate([d[k].ravel() for k in sorted(d)]) for d in (grads, run.moments))
        got.append({"gradient": flat.tobytes(), "moments": moments.tobytes()})
    grads, moments = E.step_of(net.weights, got)
    whole = E.Run(net.weights, True, np.arange(18).astype(np.uint64), (0,))
    net.through(np.concatenate(parts), whole)
    assert np.allclose(moments["spatial0_norm"], whole.moments["spatial0_norm"], rtol=1e-12, atol=1e-12) and moments["norm0"][0] == whole.moments["norm0"][0]
    assert grads.keys() == {k for k in net.weights if not k.endswith(E.FIXED)} and all(grads[k].shape == net.weights[k].shape for k in grads)


def test_a_classification_head_is_trained_with_weights_and_smoothing(spark):
    """Loss as the layers' own, gradients as differences, with dropout in front of the head; a run learns the labels."""
    config = EmbedderConfig([ConvBlock(1, 6, 5, activation="tanh")], [(8, "relu", 0.2), (3, "none", 0.0, 0.3)])
    net, rng = Embedder(config, 16, seed=5), np.random.default_rng(6)
    x, label, keys = rng.normal(size=(12, 1, 16)), np.arange(12) % 3, np.arange(12).astype(np.uint64)
    of = E.Classes((0.5, 1.0, 3.0), 0.1)
    loss, correct, _ = E.class_gradient(net, x, label, of)
    z = net.forward(x)
    logits = spark.createDataFrame([(i, o, float(v)) for i, row in enumerate(z) for o, v in enumerate(row)], "id long, o int, v double")
    truth = spark.createDataFrame([(i, int(k)) for i, k in enumerate(label)], "id long, label int")
    weights = spark.createDataFrame(list(enumerate(of.weights)), "o int, w double")
    assert abs(L.cross_entropy(L.softmax(logits), truth, 0.1, weights).first()["loss"] - loss) < 1e-9 and correct == (z.argmax(axis=1) == label).sum()
    value = lambda: E.class_gradient(net, x, label, of, E.Run(net.weights, True, keys, (1, 2)))
    for name, grad in value()[2].items():
        for at in list(np.ndindex(grad.shape))[:: max(1, grad.size // 5)]:
            old, two = net.weights[name][at], []
            for move in (1e-5, -1e-5):
                net.weights[name][at] = old + move
                two.append(value()[0])
            net.weights[name][at] = old
            assert abs((two[0] - two[1]) / 2e-5 - grad[at]) < 1e-6, (name, at)
    run = ModelConfig(n_support=4, n_query=4, iterations=60, n_classes=3, optimizer="Adam", learning_rate=0.02, schedule="none")
    waves = _waves(spark)
    done = E.train(waves, Embedder(config, 16, seed=1), run, per_step=3, seed=2, classes=E.Classes())
    assert done.history[-1][1] < 0.6 * done.history[0][1]
    # in use nothing is dropped
    rows = [(r["label"], r["data"]) for r in waves.where("guid < 900").collect()]
    guess = done.model.forward(np.array([d for _, d in rows])).argmax(axis=1)
    assert np.mean([a == b for (a, _), b in zip(rows, guess, strict=True)]) > 0.8
    with pytest.raises(ValueError, match="for 3 outputs"):
        E.class_gradient(net, x, label + 1, of)
