"""Savitzky-Golay stencils; small least-squares problems solved on the driver and inlined into plans."""

from __future__ import annotations

import math
from enum import Enum

import numpy as np


class Derivative(Enum):
    NONE = 0
    FIRST_ORDER = 1
    SECOND_ORDER = 2


class Axis(Enum):
    """Direction of a two-dimensional derivative: COLUMN is along time, ROW across channels."""

    NONE = "none"
    COLUMN = "column"
    ROW = "row"
    BOTH = "both"


def pick(kind: type[Enum], value: Enum | str | int) -> Enum:
    """A member given as itself, by name in any case, or by value."""
    if isinstance(value, kind):
        return value
    if isinstance(value, str) and value.upper() in kind.__members__:
        return kind[value.upper()]
    try:
        return kind(value)
    except ValueError:
        raise TypeError(f"{value!r} is none of {', '.join(m.name for m in kind)}") from None


def _odd_window(window: int) -> int:
    if int(window) != window or window < 3 or window % 2 == 0:
        raise TypeError(f"window must be odd and above 1, not {window}")
    return int(window)


def stencil_1d(window: int, order: int, derivative: Derivative | str | int = Derivative.NONE, rate: float = 1.0) -> list[float]:
    """Weights of x[t-h..t+h] that give the fitted polynomial's value, or derivative, at t."""
    window, d = _odd_window(window), pick(Derivative, derivative).value
    if order < 0 or window < order + 2:
        raise TypeError(f"a window of {window} is too small for order {order}")
    if d > order:
        raise TypeError(f"derivative {d} of a polynomial of order {order}")
    offsets = np.arange(-(window // 2), window // 2 + 1, dtype=float)
    design = offsets[:, None] ** np.arange(order + 1)
    return (np.linalg.pinv(design)[d] * rate**d * math.factorial(d)).tolist()


def stencil_2d(window: int, order: int, axis: Axis | str = Axis.NONE) -> np.ndarray:
    """Weights of a window-by-window patch (time by channel); a derivative's weights correlate, not convolve."""
    window, axis = _odd_window(window), pick(Axis, axis)
    if window**2 < (order + 1) * (order + 2) // 2:
        raise TypeError(f"a window of {window} is too small for order {order}")
    h = window // 2
    dt, dc = (g.ravel().astype(float) for g in np.meshgrid(np.arange(-h, h + 1), np.arange(-h, h + 1), indexing="ij"))
    design = np.stack([dt ** (k - n) * dc**n for k in range(order + 1) for n in range(k + 1)], axis=1)
    row = {Axis.NONE: 0, Axis.COLUMN: 1, Axis.ROW: 2}.get(axis)
    if row is None:
        raise TypeError("BOTH has two stencils: ask for COLUMN and for ROW")
    return np.linalg.pinv(design)[row].reshape(window, window)
