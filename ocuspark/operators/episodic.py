"""Training of the embedder by few-shot episodes.

Spark draws the episodes and computes the gradients of a step's episodes side
by side; the driver adds them up and makes the optimiser's step. An episode has
k_way * (n_support + n_query) samples, and a step's gradients are `per_step`
times the size of the network, however many samples there are.

Normalisations take the moments of the episode's batch; those of a step's
episodes are merged, and the running means and variances follow them. Episodes,
weights and the optimiser's memory lie in the shared folder, so that a run whose
driver is lost is taken up where it was saved and ends with the same weights.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parameters import ModelConfig
from ..session import shared_folder, ship
from ..sources import files
from . import targets
from .embedder import Embedder
from .network import Arrays, Run, follow, merged
from .optimisers import Optimiser

#: How fast running moments follow those of a step: of blocks, and of spatial gates.
MOMENTUM, GATE_MOMENTUM = 0.1, 0.01
FIXED = ("_mean", "_var")


def recorded(net: Embedder, x: np.ndarray, run: Run | None = None) -> tuple[np.ndarray, Callable[[np.ndarray], Arrays]]:
    """The network's output for [batch, channels, time], and a function from a loss's gradient by it to those by the weights.

    Without a run of its own it is as in use: normalisations take the moments
    that are kept with the weights, and nothing is dropped.
    """
    run = Run(net.weights) if run is None else run
    return net.through(x, run), run.back


def episode_gradient(net: Embedder, x: np.ndarray, label: np.ndarray, support: np.ndarray, run: Run | None = None) -> tuple[float, int, Arrays]:
    """Loss of an episode's queries, how many are nearest to their own prototype, and the gradients of the loss.

    The loss is that of prototypes.score(): minus the logarithm of the softmax of
    minus distance. label: numbers from 0; each has a support sample.
    """
    z, back = recorded(net, x, run)
    size = np.bincount(label[support])
    protos = np.zeros((len(size), z.shape[1]))
    np.add.at(protos, label[support], z[support] / size[label[support], None])
    own, n = label[~support], int((~support).sum())
    apart = z[~support][:, None] - protos[None]
    distance = np.sqrt((apart * apart).sum(axis=2))
    weight = np.exp(distance.min(axis=1, keepdims=True) - distance)
    p = weight / weight.sum(axis=1, keepdims=True)
    at = np.arange(n)
    loss = float(-np.log(np.maximum(p[at, own], 1e-300)).mean())
    by_distance = -p / n
    by_distance[at, own] += 1 / n
    by_apart = (by_distance / np.maximum(distance, 1e-12))[..., None] * apart
    d = np.zeros_like(z)
    d[~support] = by_apart.sum(axis=1)
    d[support] = -by_apart.sum(axis=0)[label[support]] / size[label[support], None]
    return loss, int((distance.argmin(axis=1) == own).sum()), back(d)


@dataclass
class Classes:
    """The objective of a classification head: the last linear layer has a value for each label, 0 to its size less one."""

    weights: tuple[float, ...] | None = None  # of labels; 1 each without
    smoothing: float = 0.0


def class_gradient(net: Embedder, x: np.ndarray, label: np.ndarray, of: Classes, run: Run | None = None) -> tuple[float, int, Arrays]:
    """Weighted mean cross entropy, as layers.cross_entropy() has it, how many labels are predicted, and the gradients of the loss."""
    z, back = recorded(net, x, run)
    if label.min() < 0 or label.max() >= z.shape[1]:
        raise ValueError(f"labels {label.min()} to {label.max()} for {z.shape[1]} outputs")
    w = np.ones(z.shape[1]) if of.weights is None else np.asarray(of.weights, dtype=np.float64)
    log_p = z - z.max(axis=1, keepdims=True)
    log_p -= np.log(np.exp(log_p).sum(axis=1, keepdims=True))
    target = np.full(z.shape, of.smoothing / z.shape[1])
    target[np.arange(len(z)), label] += 1 - of.smoothing
    target *= w
    total = w[label].sum()
    d = (np.exp(log_p) * target.sum(axis=1, keepdims=True) - target) / total
    return float(-(target * log_p).sum() / total), int((z.argmax(axis=1) == label).sum()), back(d)


def AdamW(rate: float, decay: float, every: int = 5, gamma: float = 0.1) -> Optimiser:  # noqa: N802
    """Adam with decoupled weight decay; the rate falls by `gamma` every `every` steps."""
    return Optimiser("AdamW", rate, decay, schedule="StepLR", schedule_options={"step_size": every, "gamma": gamma})


def optimiser_of(config: ModelConfig, every: int = 5, gamma: float = 0.1) -> Optimiser:
    """The optimiser and schedule that a configuration names; every and gamma are those of a StepLR that says nothing else."""
    own = {"step_size": every, "gamma": gamma} if config.schedule == "StepLR" else {}
    return Optimiser(config.optimizer, config.learning_rate, config.weight_decay, config.optimizer_options, config.schedule, own | config.schedule_options)


@dataclass
class Trained:
    """model: that of the best loss of validation, or the last one without validation."""

    model: Embedder
    history: list[tuple[int, float, float]]  # step, loss and accuracy of its episodes' queries, before the step
    last: Embedder | None = None
    validations: list[tuple[int, float, float]] = field(default_factory=list)  # steps done, loss and accuracy


@dataclass
class _State:
    """All that the next step depends on."""

    weights: Arrays
    best: Arrays
    optimiser: Optimiser
    history: list[tuple[int, float, float]] = field(default_factory=list)
    validations: list[tuple[int, float, float]] = field(default_factory=list)
    done: int = 0

    def save(self, spark, place: str, about: str) -> None:
        memory, numbers = self.optimiser.state()
        arrays = {f"w:{k}": v for k, v in self.weights.items()} | {f"b:{k}": v for k, v in self.best.items()} | {f"m:{k}": v for k, v in memory.items()}
        notes = {"about": about, "done": self.done, "optimiser": numbers, "history": self.history, "validations": self.validations}
        files.save_state(spark, arrays, json.dumps(notes), f"{place}/state-{self.done:09d}")

    def load(self, spark, place: str, about: str) -> None:
        """Take up the latest whole state below place, if there is one."""
        found = files.whole_folders(spark, place, "state-")
        if not found:
            return
        arrays, text = files.load_state(spark, f"{place}/{max(found)}")
        notes = json.loads(text)
        if notes["about"] != about:
            raise ValueError(f"{place} has a run of another configuration: {notes['about']}, not {about}")
        part = lambda c: {k[2:]: v for k, v in arrays.items() if k.startswith(f"{c}:")}
        self.weights, self.best, self.done = part("w"), part("b"), notes["done"]
        self.history, self.validations = ([tuple(r) for r in notes[k]] for k in ("history", "validations"))
        self.optimiser.restore(part("m"), notes["optimiser"])


def _episode(channels: int, shared, training: bool, draw: Sequence[int], classes: Classes | None) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        config, length, weights = shared.value
        net = Embedder(config, length)
        net.weights = weights
        x = np.array(table.column("data").to_pylist(), dtype=np.float64).reshape(-1, channels, length)
        given = np.array(table.column("label").to_pylist())
        label = np.unique(given, return_inverse=True)[1]
        support = np.array([r == "support" for r in table.column("role").to_pylist()])
        keys = table.column("unit").to_numpy().astype(np.int64).view(np.uint64)
        episode = table.column("episode")[0].as_py()
        # in one order, so that a task that runs again gives the same sums
        order = np.lexsort((np.array(table.column("shot").to_pylist()), label))
        own = Run(weights, training, keys[order], (*draw, episode))
        if classes is None:
            loss, correct, grads = episode_gradient(net, x[order], label[order], support[order], own)
            judged = int((~support).sum())
        else:
            loss, correct, grads = class_gradient(net, x[order], given[order], classes, own)
            judged = len(given)
        flat = np.concatenate([grads[k].ravel() for k in sorted(grads)]) if training else np.empty(0)
        moments = np.concatenate([np.empty(0), *[own.moments[k] for k in sorted(own.moments)]])
        return pa.table({
            "episode": table.column("episode")[:1], "loss": [loss], "accuracy": [correct / max(1, judged)],
            "gradient": pa.array([flat.tobytes()], pa.binary()), "moments": pa.array([moments.tobytes()], pa.binary()),
        })

    return run


_MADE = "episode int, loss double, accuracy double, gradient binary, moments binary"


def _good(samples: DataFrame, model: Embedder) -> DataFrame:
    whole = (F.size("data") == model.config.conv[0].in_channels * model.length) & ~F.exists("data", lambda v: v.isNull())
    return samples.where(F.col("label").isNotNull() & F.col("data").isNotNull() & whole).select(F.col("guid").alias("item"), "label", "data")


def _write_episodes(good: DataFrame, config: ModelConfig, episodes: int, per_step: int, seed: int, place: str) -> DataFrame:
    """Episodes drawn once, one folder a step, so that each step reads its own; those that are there already are taken."""
    spark = good.sparkSession
    drawn = targets.prototypical_episodes(good.select("label", "item"), config.n_classes, config.n_support, config.n_query, episodes, seed)
    rows = drawn.join(good.drop("label"), "item").withColumns({"unit": F.xxhash64("item"), "step": F.floor(F.col("episode") / per_step).cast("int")})
    if place.rsplit("/", 1)[1] not in files.whole_folders(spark, place.rsplit("/", 1)[0], ""):
        rows.repartition("step").write.mode("overwrite").partitionBy("step").parquet(place)
    return spark.read.schema(rows.schema).parquet(place)


def step_of(weights: Arrays, got: Sequence[dict]) -> tuple[Arrays, Arrays]:
    """Mean gradient of a step's episodes, and their moments merged by normalisation."""
    flat = sum(np.frombuffer(bytes(r["gradient"])) for r in got) / len(got)
    names = sorted(n for n in weights if not n.endswith(FIXED))
    parts = np.split(flat, np.cumsum([weights[n].size for n in names])[:-1])
    grads = {n: p.reshape(weights[n].shape) for n, p in zip(names, parts, strict=True)}
    norms = sorted(n.removesuffix("_mean") for n in weights if n.endswith("_mean"))
    cuts = np.cumsum([1 + 2 * weights[f"{n}_mean"].size for n in norms])[:-1]
    each = [np.split(np.frombuffer(bytes(r["moments"])), cuts) for r in got] if norms else []
    return grads, {n: merged([e[i] for e in each]) for i, n in enumerate(norms)}


def train(
    samples: DataFrame, model: Embedder, config: ModelConfig, per_step: int = 10, seed: int = 0, every: int = 5, gamma: float = 0.1,
    validation: DataFrame | None = None, validate_every: int = 10, validation_episodes: int = 10, path: str | None = None, save_every: int = 10,
    classes: Classes | None = None,
) -> Trained:
    """A model trained on samples (guid, label, data) by `iterations` episodes, `per_step` of them for each step of the optimiser.

    Samples of another size, or with a null in them, are not drawn; null labels
    neither. Labels of all n_classes meet in each episode, or all that there are.
    No samples leave the model as it is. The given model is not changed.

    With samples for validation, `validation_episodes` of them are drawn once and
    judged before the first step, every `validate_every` steps and after the last
    one; the weights of the lowest loss are the result. With a path (a folder of
    this run alone that the driver will find again), episodes and, every
    `save_every` steps, the state are written there, and a run that finds a state
    there goes on from it. Samples must be the same then; another configuration
    is an error. With classes, all samples of an episode are judged by the
    network's values for the labels, not queries by prototypes.
    """
    optimiser = optimiser_of(config, every, gamma)
    spark = samples.sparkSession
    ship(spark)
    channels, length = model.config.conv[0].in_channels, model.length
    place = path or f"{shared_folder(spark)}/training-{uuid.uuid4().hex}"
    about = json.dumps({"config": asdict(config), "network": asdict(model.config), "length": length, "per_step": per_step, "seed": seed, "every": every, "gamma": gamma, "validate_every": validate_every, "classes": classes and asdict(classes)}, sort_keys=True)
    state = _State(dict(model.weights), dict(model.weights), optimiser)
    if path is not None:
        state.load(spark, place, about)
    written = _write_episodes(_good(samples, model), config, config.iterations, per_step, seed, f"{place}/episodes")
    judged = None if validation is None else _write_episodes(_good(validation, model), config, validation_episodes, validation_episodes, seed + 1, f"{place}/validation")

    def ran(episodes: DataFrame, training: bool) -> list[dict]:
        shared = spark.sparkContext.broadcast((model.config, length, state.weights))
        made = episodes.groupBy("episode").applyInArrow(_episode(channels, shared, training, (seed, state.done), classes), _MADE)
        # per_step rows at most, or validation_episodes
        got = sorted((r.asDict() for r in made.collect()), key=lambda r: r["episode"])
        shared.unpersist()
        return got

    mean = lambda got, of: float(np.mean([r[of] for r in got]))

    def validate() -> None:
        if judged is None or any(k == state.done for k, *_ in state.validations):
            return
        if got := ran(judged, False):
            loss = mean(got, "loss")
            if all(loss < earlier for _, earlier, _ in state.validations):
                state.best = dict(state.weights)
            state.validations.append((state.done, loss, mean(got, "accuracy")))
            if state.done:
                optimiser.told(loss)

    steps = -(-config.iterations // per_step)
    validate()
    while state.done < steps:
        got = ran(written.where(F.col("step") == state.done), True)
        if not got:
            break
        state.history.append((state.done, mean(got, "loss"), mean(got, "accuracy")))
        grads, moments = step_of(state.weights, got)
        moved = optimiser.step(state.weights, grads)
        state.weights = follow(moved, moments, lambda n: GATE_MOMENTUM if n.startswith("spatial") else MOMENTUM)
        state.done += 1
        if state.done % validate_every == 0 or state.done == steps:
            validate()
        if path is not None and (state.done % save_every == 0 or state.done == steps):
            state.save(spark, place, about)

    def net(weights: Arrays) -> Embedder:
        out = Embedder(model.config, length)
        out.weights = dict(weights)
        return out

    return Trained(net(state.best if state.validations else state.weights), state.history, net(state.weights), state.validations)
