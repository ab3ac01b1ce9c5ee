"""The convolutional embedder: segments to vectors, by NumPy on Arrow batches with broadcast weights.

A network of several layers over whole segments is a run of dense products; as
joins it would shuffle at each layer, so this one operator runs in Python.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from .network import ACTIVATIONS, GATE_POOLS, POOLS, Run, activate


@dataclass
class ConvBlock:
    """Convolution, channel gate, spatial gate, pool, normalisation, activation; what is 0 or False is left out.

    spatial: the size of the spatial gate's kernel. pool_stride 0: that of the pool's size.
    """

    in_channels: int
    out_channels: int
    kernel: int = 3
    stride: int = 1
    padding: int = 0
    gate: bool = False
    reduction: int = 2
    pool: int = 0
    norm: bool = False
    activation: str = "relu"
    dilation: int = 1
    gate_pools: tuple[str, ...] = ("avg", "max")
    spatial: int = 0
    pool_kind: str = "max"
    pool_stride: int = 0
    pool_padding: int = 0
    pool_power: float = 2.0

    def __post_init__(self) -> None:
        self.gate_pools = tuple(self.gate_pools)
        for value, known in ((self.activation, ACTIVATIONS), (self.pool_kind, POOLS), *((k, GATE_POOLS) for k in self.gate_pools)):
            if value not in known:
                raise ValueError(f"{value} is none of {', '.join(known)}")


#: Names of layers in a JSON of layers, and ours.
LAYER_NAMES = {
    "ReLU": "relu", "Tanh": "tanh", "Sigmoid": "sigmoid", "LeakyReLU": "leaky_relu", "ELU": "elu", "Identity": "none",
    "MaxPool1d": "max", "AvgPool1d": "avg", "LPPool1d": "lp", "BatchNorm1d": "norm",
}


def _known(kind: str | None, options: dict | None, used: dict[str, object]) -> dict[str, object]:
    """options over the defaults in used; an option that is not in there and is not void is an error."""
    given = dict(options or {})
    if unknown := {k: v for k, v in given.items() if k not in used and k != "inplace" and v not in (None, False)}:
        raise ValueError(f"{kind} can't have {unknown}")
    return used | {k: v for k, v in given.items() if k in used}


def _layer(kind: str | None, kinds: tuple[str, ...]) -> str:
    found = LAYER_NAMES.get(kind or "Identity")
    if found not in kinds:
        raise ValueError(f"{kind} is none of {', '.join(k for k, v in LAYER_NAMES.items() if v in kinds)}")
    return found


def _one(x: object) -> int:
    """A size that may be given as a list of one."""
    return int(x[0] if isinstance(x, list | tuple) else x)


@dataclass
class EmbedderConfig:
    """fc: size and activation of each linear layer; then, if given, the dropout after it (before its activation) and the dropout before it."""

    conv: list[ConvBlock]
    fc: list[tuple] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=4, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> EmbedderConfig:
        raw = json.loads(text)
        return cls([ConvBlock(**b) for b in raw["conv"]], [tuple(x) for x in raw["fc"]])

    @classmethod
    def from_layers(cls, text: str) -> EmbedderConfig:
        """From JSON that lists the layers: conv (conv, cbam, pool_type, pool, norm_type, norm, activation_type) and fc (linear, dropout, activation_type).

        Options and layers that this network does not have are an error, as are sizes that do not fit together.
        """
        raw = json.loads(text)
        blocks: list[ConvBlock] = []
        for b in raw.get("conv", []):
            c = _known("conv", b["conv"], {"in_channels": 0, "out_channels": 0, "kernel_size": 0, "stride": 1, "padding": 0, "dilation": 1, "groups": 1, "bias": True})
            if c["groups"] != 1 or not c["bias"]:
                raise ValueError("convolutions have one group and a bias")
            own: dict[str, object] = {"activation": _layer(b.get("activation_type"), tuple(ACTIVATIONS))}
            if (gate := b.get("cbam")) is not None:
                g = _known("cbam", gate, {"gate_channels": c["out_channels"], "reduction_ratio": 16, "pool_types": ("avg", "max"), "no_spatial": False})
                if g["gate_channels"] != c["out_channels"]:
                    raise ValueError(f"a gate of {g['gate_channels']} channels on {c['out_channels']}")
                own |= {"gate": True, "reduction": g["reduction_ratio"], "gate_pools": tuple(g["pool_types"]), "spatial": 0 if g["no_spatial"] else 3}
            if b.get("pool_type"):
                p = _known(b["pool_type"], b.get("pool"), {"kernel_size": 0, "stride": None, "padding": 0, "norm_type": 2.0})
                own |= {"pool": _one(p["kernel_size"]), "pool_stride": _one(p["stride"] or 0), "pool_padding": _one(p["padding"]), "pool_kind": _layer(b["pool_type"], POOLS), "pool_power": float(p["norm_type"])}
            if b.get("norm_type"):
                n = _known(b["norm_type"], b.get("norm"), {"num_features": c["out_channels"]})
                if _layer(b["norm_type"], ("norm",)) and n["num_features"] != c["out_channels"]:
                    raise ValueError(f"a normalisation of {n['num_features']} channels on {c['out_channels']}")
                own["norm"] = True
            blocks.append(ConvBlock(c["in_channels"], c["out_channels"], _one(c["kernel_size"]), _one(c["stride"]), _one(c["padding"]), dilation=_one(c["dilation"]), **own))
        if any(a.out_channels != b.in_channels for a, b in zip(blocks, blocks[1:], strict=False)):
            raise ValueError("channels of one block are not those of the next")
        fc: list[tuple] = []
        for b in raw.get("fc", []):
            linear = _known("linear", b["linear"], {"in_features": None, "out_features": 0})
            if fc and linear["in_features"] not in (None, fc[-1][0]):
                raise ValueError(f"a linear layer of {linear['in_features']} values on {fc[-1][0]}")
            fc.append((linear["out_features"], _layer(b.get("activation_type"), tuple(ACTIVATIONS)), float(_known("dropout", b.get("dropout"), {"p": 0.0})["p"])))
        return cls(blocks, fc)


class Embedder:
    """The network. Weights: Glorot-uniform from a seed, biases of 0; or a table of (layer, shape, values)."""

    def __init__(self, config: EmbedderConfig, length: int, seed: int = 0) -> None:
        self.config, self.length = config, length
        rng = np.random.default_rng(seed)
        self.weights: dict[str, np.ndarray] = {}

        def glorot(name: str, *shape: int, fan: tuple[int, int]) -> None:
            bound = np.sqrt(6 / sum(fan))
            self.weights[name] = rng.uniform(-bound, bound, shape)

        def norm(name: str, size: int) -> None:
            for part, value in (("mean", 0.0), ("var", 1.0), ("gamma", 1.0), ("beta", 0.0)):
                self.weights[f"{name}_{part}"] = np.full(size, value)

        for i, b in enumerate(config.conv):
            glorot(f"conv{i}", b.out_channels, b.in_channels, b.kernel, fan=(b.in_channels * b.kernel, b.out_channels * b.kernel))
            self.weights[f"conv{i}_bias"] = np.zeros(b.out_channels)
            if b.gate:
                small = max(1, b.out_channels // b.reduction)
                glorot(f"gate{i}_in", small, b.out_channels, fan=(b.out_channels, small))
                glorot(f"gate{i}_out", b.out_channels, small, fan=(small, b.out_channels))
                self.weights[f"gate{i}_in_bias"], self.weights[f"gate{i}_out_bias"] = np.zeros(small), np.zeros(b.out_channels)
            if b.spatial:
                glorot(f"spatial{i}", 1, 2, b.spatial, fan=(2 * b.spatial, b.spatial))
                norm(f"spatial{i}_norm", 1)
            if b.norm:
                norm(f"norm{i}", b.out_channels)
        size = self._convolve(np.zeros((1, config.conv[0].in_channels, length)), Run(self.weights)).size
        for i, (out, *_) in enumerate(config.fc):
            glorot(f"fc{i}", out, size, fan=(size, out))
            self.weights[f"fc{i}_bias"] = np.zeros(out)
            size = out
        self.size = size

    def _convolve(self, x: np.ndarray, run: Run) -> np.ndarray:
        for i, b in enumerate(self.config.conv):
            x = run.then(run.convolve(x, f"conv{i}", b.stride, b.padding, b.dilation))
            if b.gate:
                x = run.then(run.channel_gate(x, f"gate{i}", b.gate_pools))
            if b.spatial:
                x = run.then(run.spatial_gate(x, f"spatial{i}"))
            if b.pool > 1:
                x = run.then(run.pool(x, b.pool_kind, b.pool, b.pool_stride or b.pool, b.pool_padding, b.pool_power))
            if b.norm:
                x = run.then(run.normalise(x, f"norm{i}"))
            x = run.then(activate(x, b.activation))
        return x

    def through(self, x: np.ndarray, run: Run) -> np.ndarray:
        """[sample, channel, place] to [sample, size]; run has what is needed for the way back."""
        x = self._convolve(x, run)
        shape = x.shape
        x = run.then((x.reshape(len(x), -1), lambda d: d.reshape(shape)))
        for i, (_, activation, *drop) in enumerate(self.config.fc):
            after, before = (*drop, 0.0, 0.0)[:2]
            x = run.then(run.dropout(x, before, 2 * i))
            x = run.then(run.linear(x, f"fc{i}"))
            x = run.then(run.dropout(x, after, 2 * i + 1))
            x = run.then(activate(x, activation))
        return x

    def forward(self, x: np.ndarray) -> np.ndarray:
        """[batch, channels, time] (a channel axis is added to [batch, time], a trailing 1 is dropped) to [batch, size]."""
        if x.ndim == 2:
            x = x[:, None, :]
        if x.ndim == 4:
            x = x[..., 0]
        return self.through(x, Run(self.weights))


def embed(segments: DataFrame, model: Embedder, id_column: str = "guid") -> DataFrame:
    """id and embedding of each segment; data: channels times time, flat. A row with a null in it, or of another size, gets null."""
    ship(segments.sparkSession)
    shared = segments.sparkSession.sparkContext.broadcast((model.config, model.length, model.weights))
    channels, length = model.config.conv[0].in_channels, model.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        config, size, weights = shared.value
        net = Embedder(config, size)
        net.weights = weights
        for batch in batches:
            rows = batch.column("data").to_pylist()
            good = [i for i, r in enumerate(rows) if r is not None and len(r) == channels * length and None not in r]
            out: list[list[float] | None] = [None] * len(rows)
            if good:
                x = np.array([rows[i] for i in good], dtype=np.float64).reshape(-1, channels, length)
                for i, v in zip(good, net.forward(x), strict=True):
                    out[i] = v.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=[id_column, "embedding"])

    return segments.select(id_column, "data").mapInArrow(run, f"`{id_column}` {segments.schema[id_column].dataType.simpleString()}, embedding array<double>")
