"""Weights from search parameters, and back; small vectors on the driver."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

#: Added before a linear weight is divided by the sum, and the least weight whose logarithm is taken. (fixed values)
EPSILON, FLOOR = 1e-8, 1e-10
METHODS = ("softmax", "linear")


def softmax(z: Sequence[float]) -> list[float]:
    if not z:
        return []
    top = max(z)
    e = [math.exp(x - top) for x in z]
    return [x / sum(e) for x in e]


def linear(z: Sequence[float], low: float) -> list[float]:
    shifted = [x - low + EPSILON for x in z]
    total = sum(shifted)
    return [x / total for x in shifted] if shifted else []


def weights_of(z: Sequence[float], method: str, span: tuple[float, float]) -> list[float]:
    """Weights that add up to 1."""
    if method == "softmax":
        return softmax(z)
    if method == "linear":
        return linear(z, span[0])
    raise ValueError(f"unknown normalization method {method!r}; known: {', '.join(METHODS)}")


def parameters_of(weights: Mapping[str, float], keys: Sequence[str], method: str, span: tuple[float, float]) -> dict[str, float]:
    """Parameters within span that give about these weights; an absent key counts as 1 / number of keys."""
    low, high = span
    out = {}
    for key in keys:
        w = float(weights.get(key, 1.0 / len(keys)))
        if method == "softmax":
            z = math.log(max(w, FLOOR))
        elif method == "linear":
            z = low + w * (high - low)
        else:
            raise ValueError(f"unknown normalization method {method!r}")
        out[f"z_{key}"] = min(max(z, low), high)
    return out


def signature(weights: Mapping[str, float], keys: Sequence[str]) -> tuple[float, ...]:
    """Weights in the order of keys as shares of all weights (unknown keys count in the sum), to four places, rounded as Python does."""
    total = sum(weights.values())
    return tuple(round(weights.get(key, 0.0) / total if total > 0 else weights.get(key, 0.0), 4) for key in keys)


def parameter_signature(z: Mapping[str, float], keys: Sequence[str], method: str, span: tuple[float, float]) -> tuple[float, ...]:
    return tuple(round(w, 4) for w in weights_of([z[f"z_{key}"] for key in keys], method, span))


def good_trials(n: int, share: float = 0.1, most: int = 25) -> int:
    """How many of n finished trials count as good."""
    return min(math.ceil(share * n), most)
