"""Layers of the embedder on arrays [sample, channel, place].

Each layer gives its output, and puts a function from a loss's gradient by it to
that by its input on the run; gradients by weights are left in the run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

Back = Callable[[np.ndarray], np.ndarray]
Arrays = dict[str, np.ndarray]

EPS = 1e-5
GATE_POOLS, POOLS = ("avg", "max", "lp", "lse"), ("max", "avg", "lp")


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values by which neighbours lie far apart."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Run:
    """One pass through a network.

    training: normalisations take the batch's own moments, which are kept in
    moments by name as (count, means, sums of squared deviations), and dropout
    drops. What it drops depends on draw (seed, step and the like), the key of
    each sample, the layer and the unit, so a task that runs again drops the same.
    """

    def __init__(self, weights: Arrays, training: bool = False, keys: np.ndarray | None = None, draw: Sequence[int] = ()) -> None:
        self.w, self.training, self.keys, self.draw = weights, training, keys, draw
        self.grads: Arrays = {}
        self.moments: Arrays = {}
        self.backs: list[Back] = []

    def then(self, made: tuple[np.ndarray, Back]) -> np.ndarray:
        self.backs.append(made[1])
        return made[0]

    def back(self, d: np.ndarray) -> Arrays:
        """Gradients by the weights, from that by the output."""
        for f in reversed(self.backs):
            d = f(d)
        return self.grads

    def convolve(self, x: np.ndarray, name: str, stride: int = 1, padding: int = 0, dilation: int = 1) -> tuple[np.ndarray, Back]:
        """Cross-correlation with taps `dilation` places apart; a bias if there is one of the name."""
        w, bias, time = self.w[name], self.w.get(f"{name}_bias"), x.shape[2]
        x = np.pad(x, ((0, 0), (0, 0), (padding, padding)))
        reach = (w.shape[2] - 1) * dilation + 1
        if x.shape[2] < reach:
            raise ValueError(f"{name} reaches over {reach} places, of {x.shape[2]}")
        patches = np.lib.stride_tricks.sliding_window_view(x, reach, axis=2)[:, :, ::stride, ::dilation]
        y = np.tensordot(patches, w, axes=([1, 3], [1, 2])).transpose(0, 2, 1)

        def back(d: np.ndarray) -> np.ndarray:
            self.grads[name] = np.tensordot(d, patches, axes=([0, 2], [0, 2]))
            if bias is not None:
                self.grads[f"{name}_bias"] = d.sum(axis=(0, 2))
            each, out = np.tensordot(d, w, axes=([1], [0])), np.zeros_like(x)  # [sample, place, channel, tap]
            for k in range(w.shape[2]):
                at = k * dilation
                out[:, :, at : at + stride * (d.shape[2] - 1) + 1 : stride] += each[..., k].transpose(0, 2, 1)
            return out[:, :, padding : padding + time]

        return y if bias is None else y + bias[:, None], back

    def channel_gate(self, x: np.ndarray, name: str, kinds: Sequence[str]) -> tuple[np.ndarray, Back]:
        """x by the sigmoid of the sum, over kinds of pooling over time, of a network of two layers that all share."""
        w_in, w_out = self.w[f"{name}_in"], self.w[f"{name}_out"]
        pooled, pool_backs = zip(*(_over_time(x, kind) for kind in kinds), strict=True)
        hidden = [np.maximum(p @ w_in.T + self.w[f"{name}_in_bias"], 0) for p in pooled]
        s = _sigmoid(sum(h @ w_out.T + self.w[f"{name}_out_bias"] for h in hidden))

        def back(d: np.ndarray) -> np.ndarray:
            d_sum = (d * x).sum(axis=2) * s * (1 - s)
            d_hidden = [(d_sum @ w_out) * (h > 0) for h in hidden]
            self.grads[f"{name}_out"], self.grads[f"{name}_out_bias"] = sum(d_sum.T @ h for h in hidden), len(kinds) * d_sum.sum(axis=0)
            self.grads[f"{name}_in"], self.grads[f"{name}_in_bias"] = sum(h.T @ p for h, p in zip(d_hidden, pooled, strict=True)), sum(h.sum(axis=0) for h in d_hidden)
            return d * s[:, :, None] + sum(f(h @ w_in) for f, h in zip(pool_backs, d_hidden, strict=True))

        return x * s[:, :, None], back

    def spatial_gate(self, x: np.ndarray, name: str) -> tuple[np.ndarray, Back]:
        """x by the sigmoid, at each place, of a normalised convolution of the channels' largest and mean value."""
        own = Run(self.w, self.training)
        own.grads, own.moments = self.grads, self.moments
        top = x.argmax(axis=1)[:, None]
        both = np.concatenate([np.take_along_axis(x, top, axis=1), x.mean(axis=1, keepdims=True)], axis=1)
        g = own.then(own.convolve(both, name, padding=(self.w[name].shape[2] - 1) // 2))
        if g.shape[2] != x.shape[2]:
            raise ValueError(f"{name} has a kernel of {self.w[name].shape[2]}, which is not odd")
        s = _sigmoid(own.then(own.normalise(g, f"{name}_norm")))

        def back(d: np.ndarray) -> np.ndarray:
            by_both = (d * x).sum(axis=1, keepdims=True) * s * (1 - s)
            for f in reversed(own.backs):
                by_both = f(by_both)
            out = d * s + by_both[:, 1:] / x.shape[1]
            np.put_along_axis(out, top, np.take_along_axis(out, top, axis=1) + by_both[:, :1], axis=1)
            return out

        return x * s, back

    def pool(self, x: np.ndarray, kind: str, size: int, stride: int, padding: int = 0, power: float = 2.0) -> tuple[np.ndarray, Back]:
        """max, avg (padding counts, as zeros) or lp over windows of size, which overlap where stride is smaller."""
        time = x.shape[2]
        x = np.pad(x, ((0, 0), (0, 0), (padding, padding)), constant_values=-np.inf if kind == "max" else 0)
        if x.shape[2] < size:
            raise ValueError(f"a pool of {size} places, of {x.shape[2]}")
        windows = np.lib.stride_tricks.sliding_window_view(x, size, axis=2)[:, :, ::stride]
        if kind == "max":
            chosen = windows.argmax(axis=3)
            y = np.take_along_axis(windows, chosen[..., None], axis=3)[..., 0]
            part = lambda k, d: d * (chosen == k)
        elif kind == "avg":
            y = windows.mean(axis=3)
            part = lambda k, d: d / size
        else:
            total = (windows**power).sum(axis=3)
            y = np.maximum(total, 0) ** (1 / power)
            scale = np.where(total > 0, np.maximum(total, 1e-300) ** (1 / power - 1), 0)
            part = lambda k, d: d * scale * windows[..., k] ** (power - 1)

        def back(d: np.ndarray) -> np.ndarray:
            out = np.zeros_like(x)
            for k in range(size):
                out[:, :, k : k + stride * (d.shape[2] - 1) + 1 : stride] += part(k, d)
            return out[:, :, padding : padding + time]

        return y, back

    def normalise(self, x: np.ndarray, name: str) -> tuple[np.ndarray, Back]:
        """Each channel by its moments: the batch's in training, else those kept with the weights."""
        gamma, beta = self.w[f"{name}_gamma"][:, None], self.w[f"{name}_beta"][:, None]
        many = x.shape[0] * x.shape[2]
        if self.training:
            mean = x.mean(axis=(0, 2))
            squares = ((x - mean[:, None]) ** 2).sum(axis=(0, 2))
            self.moments[name] = np.concatenate([[many], mean, squares])
            var = squares / many
        else:
            mean, var = self.w[f"{name}_mean"], self.w[f"{name}_var"]
        scale = np.sqrt(var + EPS)[:, None]
        centred = (x - mean[:, None]) / scale

        def back(d: np.ndarray) -> np.ndarray:
            self.grads[f"{name}_gamma"], self.grads[f"{name}_beta"] = (d * centred).sum(axis=(0, 2)), d.sum(axis=(0, 2))
            d = d * gamma
            if self.training:  # mean and variance depend on every value
                d = d - d.sum(axis=(0, 2), keepdims=True)[0] / many - centred * (d * centred).sum(axis=(0, 2))[:, None] / many
            return d / scale

        return centred * gamma + beta, back

    def linear(self, x: np.ndarray, name: str) -> tuple[np.ndarray, Back]:
        def back(d: np.ndarray) -> np.ndarray:
            self.grads[name], self.grads[f"{name}_bias"] = d.T @ x, d.sum(axis=0)
            return d @ self.w[name]

        return x @ self.w[name].T + self.w[f"{name}_bias"], back

    def dropout(self, x: np.ndarray, share: float, layer: int) -> tuple[np.ndarray, Back]:
        """In training, a share of the units of each sample is 0, and the others grow so that sums stay as they are on average."""
        if not self.training or share <= 0:
            return x, lambda d: d
        if share >= 1:
            raise ValueError(f"a dropout of {share}")
        draw = np.zeros(1, dtype=np.uint64)
        for part in (*self.draw, layer):
            draw = spread(draw + np.uint64(part & (2**64 - 1)) + np.uint64(0x9E3779B97F4A7C15))
        hashed = spread(spread(draw + self.keys.astype(np.uint64))[:, None] + np.arange(1, x.shape[1] + 1, dtype=np.uint64))
        kept = ((hashed >> np.uint64(11)).astype(np.float64) * 2.0**-53 >= share) / (1 - share)
        return x * kept, lambda d: d * kept


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _over_time(x: np.ndarray, kind: str) -> tuple[np.ndarray, Back]:
    """[sample, channel] of a whole row of places."""
    if kind == "avg":
        return x.mean(axis=2), lambda d: np.broadcast_to(d[:, :, None] / x.shape[2], x.shape)
    if kind == "max":
        top = x.argmax(axis=2)[..., None]

        def back(d: np.ndarray) -> np.ndarray:
            out = np.zeros_like(x)
            np.put_along_axis(out, top, d[..., None], axis=2)
            return out

        return np.take_along_axis(x, top, axis=2)[..., 0], back
    if kind == "lp":
        y = np.sqrt((x * x).sum(axis=2))
        return y, lambda d: (d / np.maximum(y, 1e-300))[:, :, None] * x
    if kind == "lse":
        top = x.max(axis=2, keepdims=True)
        e = np.exp(x - top)
        total = e.sum(axis=2, keepdims=True)
        return (top + np.log(total))[..., 0], lambda d: d[:, :, None] * e / total
    raise ValueError(f"{kind} is none of {', '.join(GATE_POOLS)}")


def _leaky(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slope = np.where(x > 0, 1.0, 0.01)
    return x * slope, slope


def _tanh(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = np.tanh(x)
    return y, 1 - y * y


def _elu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.exp(np.minimum(x, 0))
    return np.where(x > 0, x, e - 1), np.where(x > 0, 1.0, e)


def _squashed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = _sigmoid(x)
    return y, y * (1 - y)


#: Value and slope of each activation.
ACTIVATIONS: dict[str, Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]] = {
    "none": lambda x: (x, np.ones(())), "relu": lambda x: (np.maximum(x, 0), (x > 0).astype(np.float64)), "leaky_relu": _leaky, "elu": _elu, "tanh": _tanh, "sigmoid": _squashed,
}


def activate(x: np.ndarray, kind: str) -> tuple[np.ndarray, Back]:
    y, slope = ACTIVATIONS[kind](x)
    return y, lambda d: d * slope


def merged(moments: Sequence[np.ndarray]) -> np.ndarray:
    """Moments (count, means, sums of squared deviations) of all rows, from those of parts."""
    out = moments[0].copy()
    size = (len(out) - 1) // 2
    for m in moments[1:]:
        count = out[0] + m[0]
        apart = m[1 : size + 1] - out[1 : size + 1]
        out[1 : size + 1] += apart * m[0] / count
        out[size + 1 :] += m[size + 1 :] + apart * apart * out[0] * m[0] / count
        out[0] = count
    return out


def follow(weights: Arrays, moments: Arrays, momentum: Callable[[str], float]) -> Arrays:
    """weights with running means and variances (of a sample: sums over count less one) moved towards those of a step."""
    out = dict(weights)
    for name, m in moments.items():
        size, rate = (len(m) - 1) // 2, momentum(name)
        out[f"{name}_mean"] = (1 - rate) * weights[f"{name}_mean"] + rate * m[1 : size + 1]
        out[f"{name}_var"] = (1 - rate) * weights[f"{name}_var"] + rate * m[size + 1 :] / max(1.0, m[0] - 1)
    return out
