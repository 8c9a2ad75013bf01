"""A tree-structured Parzen estimator over independent bounded parameters (Bergstra et al., 2011)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

_SQRT2 = math.sqrt(2.0)
_erf = np.vectorize(math.erf, otypes=[float])


class Parzen:
    """A mixture of Gaussians cut off at the range: one at each observation, and a wide one over the range."""

    def __init__(self, seen: np.ndarray, low: float, high: float):
        self.low, self.high = low, high
        centre = np.sort(np.append(seen, (low + high) / 2))
        gaps = np.diff(np.r_[low, centre, high])
        width = np.maximum(gaps[:-1], gaps[1:])
        least = (high - low) / min(100.0, 1.0 + len(centre))
        width = np.clip(width, least, high - low)
        width[int(np.searchsorted(centre, (low + high) / 2))] = high - low
        self.centre, self.width = centre, width
        self.inside = np.maximum(self._below(high) - self._below(low), 1e-12)

    def _below(self, x: float | np.ndarray) -> np.ndarray:
        return 0.5 * (1 + _erf((x - self.centre) / (self.width * _SQRT2)))

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        out = np.empty(0)
        while len(out) < n:
            at = rng.integers(0, len(self.centre), 2 * n)
            x = rng.normal(self.centre[at], self.width[at])
            out = np.append(out, x[(x >= self.low) & (x <= self.high)])
        return out[:n]

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.centre) / self.width
        d = np.exp(-0.5 * z * z) / (self.width * math.sqrt(2 * math.pi) * self.inside)
        return np.log(d.mean(1) + 1e-300)


class Joint:
    """A mixture with one component for each observation of all parameters together, and a wide one over their ranges."""

    def __init__(self, seen: np.ndarray, low: float, high: float):
        n, d = seen.shape
        self.low, self.high = low, high
        # Scott's rule for the widths, between a share of the range and the range.
        width = np.clip((high - low) * (n + 1) ** (-1.0 / (d + 4)) / 3, (high - low) / 100, high - low)
        self.centre = np.r_[seen, np.full((1, d), (low + high) / 2)]
        self.width = np.r_[np.full(n, width), high - low][:, None]
        below = lambda x: 0.5 * (1 + _erf((x - self.centre) / (self.width * _SQRT2)))
        self.inside = np.maximum(below(high) - below(low), 1e-12)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        at = rng.integers(0, len(self.centre), n)
        out = np.full((n, self.centre.shape[1]), np.nan)
        while (left := np.isnan(out)).any():
            x = rng.normal(self.centre[at], np.broadcast_to(self.width[at], out.shape))
            ok = left & (x >= self.low) & (x <= self.high)
            out[ok] = x[ok]
        return out

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None, :] - self.centre) / self.width
        each = (-0.5 * z * z - np.log(self.width * math.sqrt(2 * math.pi) * self.inside)).sum(2)
        top = each.max(1, keepdims=True)
        return (top + np.log(np.exp(each - top).mean(1, keepdims=True)))[:, 0]


def suggest(names: list[str], history: list[tuple[dict[str, float], float]], low: float, high: float, rng: np.random.Generator, startup: int, good: Callable[[int], int], candidates: int = 500, joint: bool = False) -> dict[str, float]:
    """The next point: uniform for the first `startup` trials, then the candidate that good trials make likeliest against the others.

    joint: one density over all parameters together instead of one for each.
    """
    done = sorted(((p, v) for p, v in history if v is not None and math.isfinite(v)), key=lambda x: x[1])
    k = good(len(done))
    if len(done) < max(startup, 2) or k < 1 or k >= len(done):
        return {n: float(rng.uniform(low, high)) for n in names}
    best = {n: np.array([p[n] for p, _ in done[:k]]) for n in names}
    rest = {n: np.array([p[n] for p, _ in done[k:]]) for n in names}
    if joint:
        own = lambda part: np.stack([part[n] for n in names], 1)
        better, worse = Joint(own(best), low, high), Joint(own(rest), low, high)
        points = better.draw(rng, candidates)
        at = int((better.log_density(points) - worse.log_density(points)).argmax())
        return {n: float(x) for n, x in zip(names, points[at], strict=True)}
    drawn, gain = {}, {}
    for n in names:
        better, worse = Parzen(best[n], low, high), Parzen(rest[n], low, high)
        drawn[n] = better.draw(rng, candidates)
        gain[n] = better.log_density(drawn[n]) - worse.log_density(drawn[n])
    return {n: float(drawn[n][int(gain[n].argmax())]) for n in names}
