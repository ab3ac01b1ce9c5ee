"""Optimisers and schedules of the rate, by name, over tables of weights.

All that a step depends on is in state(), so a run can be taken up where it ended.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

import numpy as np

Arrays = dict[str, np.ndarray]


def _options(kind: str, given: Mapping[str, object], known: dict[str, object]) -> dict[str, object]:
    if unknown := [k for k in given if k not in known]:
        raise ValueError(f"{kind} has no {', '.join(unknown)}; it has {', '.join(known)}")
    return known | dict(given)


class _Rule:
    """One weight's move, by its gradient and its memory, which has a place for each of `memory`."""

    memory: tuple[str, ...] = ()
    defaults: dict[str, object] = {}

    def __init__(self, options: Mapping[str, object]) -> None:
        self.o = _options(type(self).__name__, options, self.defaults)

    def move(self, w: np.ndarray, g: np.ndarray, m: Arrays, done: int, rate: float, decay: float) -> np.ndarray:
        raise NotImplementedError


class SGD(_Rule):
    """Momentum, also Nesterov's; decay is added to the gradient."""

    memory, defaults = ("speed",), {"momentum": 0.0, "dampening": 0.0, "nesterov": False}

    def move(self, w, g, m, done, rate, decay):
        g = g + decay * w
        if self.o["momentum"]:
            m["speed"] = g if done == 1 else self.o["momentum"] * m["speed"] + (1 - self.o["dampening"]) * g
            g = g + self.o["momentum"] * m["speed"] if self.o["nesterov"] else m["speed"]
        return w - rate * g


class RMSprop(_Rule):
    memory, defaults = ("square", "mean", "speed"), {"alpha": 0.99, "eps": 1e-8, "momentum": 0.0, "centered": False}

    def move(self, w, g, m, done, rate, decay):
        g, a = g + decay * w, self.o["alpha"]
        m["square"] = a * m["square"] + (1 - a) * g * g
        under = m["square"]
        if self.o["centered"]:
            m["mean"] = a * m["mean"] + (1 - a) * g
            under = under - m["mean"] ** 2
        step = g / (np.sqrt(under) + self.o["eps"])
        if self.o["momentum"]:
            step = m["speed"] = self.o["momentum"] * m["speed"] + step
        return w - rate * step


class Adam(_Rule):
    """Decay is added to the gradient."""

    memory, defaults = ("first", "second"), {"betas": (0.9, 0.999), "eps": 1e-8}
    decoupled = False

    def move(self, w, g, m, done, rate, decay):
        b1, b2 = self.o["betas"]
        if self.decoupled:
            w = w * (1 - rate * decay)
        else:
            g = g + decay * w
        m["first"] = b1 * m["first"] + (1 - b1) * g
        m["second"] = b2 * m["second"] + (1 - b2) * g * g
        mean, square = m["first"] / (1 - b1**done), m["second"] / (1 - b2**done)
        return w - rate * mean / (np.sqrt(square) + self.o["eps"])


class AdamW(Adam):
    """Adam whose decay shrinks the weights themselves."""

    decoupled = True


class Adagrad(_Rule):
    memory, defaults = ("square",), {"eps": 1e-10, "lr_decay": 0.0}

    def move(self, w, g, m, done, rate, decay):
        g = g + decay * w
        m["square"] = m["square"] + g * g
        return w - rate / (1 + (done - 1) * self.o["lr_decay"]) * g / (np.sqrt(m["square"]) + self.o["eps"])


RULES: dict[str, type[_Rule]] = {r.__name__: r for r in (AdamW, Adam, SGD, RMSprop, Adagrad)}


def _step(done: int, o: dict) -> float:
    return o["gamma"] ** (done // o["step_size"])


def _milestones(done: int, o: dict) -> float:
    return o["gamma"] ** sum(done >= m for m in o["milestones"])


def _cosine(done: int, o: dict) -> float:
    """From 1 to `least` (a share of the rate) in `T_max` steps, and back again."""
    return o["least"] + (1 - o["least"]) * (1 + math.cos(math.pi * done / o["T_max"])) / 2


#: Share of the rate after so many steps, and options with their defaults.
SCHEDULES: dict[str, tuple[Callable[[int, dict], float], dict[str, object]]] = {
    "none": (lambda done, o: 1.0, {}),
    "StepLR": (_step, {"step_size": 5, "gamma": 0.1}),
    "MultiStepLR": (_milestones, {"milestones": (), "gamma": 0.1}),
    "ExponentialLR": (lambda done, o: o["gamma"] ** done, {"gamma": 0.9}),
    "CosineAnnealingLR": (_cosine, {"T_max": 100, "least": 0.0}),
    "ReduceLROnPlateau": (lambda done, o: 1.0, {"factor": 0.1, "patience": 10, "threshold": 1e-4, "cooldown": 0, "min_lr": 0.0}),
}


class Optimiser:
    """A rule and a schedule. Weights without a gradient stay."""

    def __init__(self, rule: str, rate: float, decay: float = 0.0, options: Mapping[str, object] | None = None, schedule: str = "none", schedule_options: Mapping[str, object] | None = None) -> None:
        if rule not in RULES:
            raise ValueError(f"{rule} is none of {', '.join(RULES)}")
        if schedule not in SCHEDULES:
            raise ValueError(f"{schedule} is none of {', '.join(SCHEDULES)}")
        self.rule, self.base, self.decay, self.schedule = RULES[rule](options or {}), rate, decay, schedule
        self.share, known = SCHEDULES[schedule]
        self.o = _options(schedule, schedule_options or {}, known)
        self.done, self.memory = 0, {}
        # of a plateau: the rate now, the best loss, and steps since it and since the last fall
        self.now, self.best, self.bad, self.rest = rate, math.inf, 0, 0

    @property
    def rate(self) -> float:
        """Of the next step."""
        return self.now if self.schedule == "ReduceLROnPlateau" else self.base * self.share(self.done, self.o)

    def step(self, weights: Arrays, grads: Arrays) -> Arrays:
        """New weights."""
        rate = self.rate
        self.done += 1
        out = dict(weights)
        for name, g in grads.items():
            own = self.memory.setdefault(name, {m: np.zeros_like(g, dtype=np.float64) for m in self.rule.memory})
            out[name] = self.rule.move(weights[name], g, own, self.done, rate, self.decay)
        return out

    def told(self, loss: float) -> None:
        """A loss of validation: on a plateau, the rate falls when more than `patience` of them in a row were no better than the best."""
        if self.schedule != "ReduceLROnPlateau":
            return
        if loss < self.best * (1 - self.o["threshold"]):
            self.best, self.bad = loss, 0
        else:
            self.bad += 1
        if self.rest > 0:
            self.rest, self.bad = self.rest - 1, 0
        if self.bad > self.o["patience"]:
            self.now, self.bad, self.rest = max(self.now * self.o["factor"], self.o["min_lr"]), 0, self.o["cooldown"]

    def state(self) -> tuple[Arrays, dict[str, float]]:
        arrays = {f"{name}/{m}": v for name, own in self.memory.items() for m, v in own.items()}
        return arrays, {"done": self.done, "now": self.now, "best": self.best, "bad": self.bad, "rest": self.rest}

    def restore(self, arrays: Arrays, numbers: Mapping[str, float]) -> None:
        self.memory = {}
        for key, v in arrays.items():
            name, m = key.rsplit("/", 1)
            self.memory.setdefault(name, {})[m] = v
        self.done, self.bad, self.rest = (int(numbers[k]) for k in ("done", "bad", "rest"))
        self.now, self.best = float(numbers["now"]), float(numbers["best"])
