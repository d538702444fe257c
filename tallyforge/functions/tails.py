"""Adaptive extreme-value threshold of one series, stepped point by point (SPOT)."""

from __future__ import annotations

import math

import numpy as np


def fit_tail(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of the generalised Pareto law that fits the excesses best.

    With s = 1 + t*y, stationary points of the profile likelihood are the roots of
    mean(1/s) * (1 + mean(log s)) = 1; t = 0 is the exponential law.
    """
    mean, low, high = excess.mean(), excess.min(), excess.max()
    if high <= 0 or mean <= 0:
        return 0.0, max(float(mean), 1e-12)

    def gap(t: np.ndarray) -> np.ndarray:
        s = 1.0 + np.outer(t, excess)
        return (1.0 + np.log(s).mean(axis=1)) * (1.0 / s).mean(axis=1) - 1.0

    def likelihood(t: float) -> tuple[float, float, float]:
        shape = float(np.log1p(t * excess).mean())
        scale = shape / t
        return -len(excess) * (math.log(scale) + shape + 1.0), shape, scale

    best = (-len(excess) * (1.0 + math.log(mean)), 0.0, float(mean))
    small = 1e-8 / high
    spans = [(-1.0 / high * (1 - 1e-6), -small)]
    if low > 0 and mean > low:
        spans.append((min(small, 2 * (mean - low) / (mean * low)), 2 * (mean - low) / low ** 2))
    for left, right in spans:
        grid = (-np.geomspace(-left, -right, 24) if right < 0 else np.geomspace(left, right, 24))
        at = gap(grid)
        for i in np.flatnonzero(np.sign(at[:-1]) * np.sign(at[1:]) < 0):
            a, b, fa = grid[i], grid[i + 1], at[i]
            for _ in range(30):
                middle = (a + b) / 2
                value = gap(np.array([middle]))[0]
                a, fa, b = (middle, value, b) if np.sign(value) == np.sign(fa) else (a, fa, middle)
            found = likelihood((a + b) / 2)
            if found[0] > best[0]:
                best = found
    return best[1], best[2]


class Side:
    """Threshold on one side of a series; sign is +1 above and -1 below."""

    def __init__(self, sign: int, start: np.ndarray, level: float, risk: float):
        ordered = np.sort(sign * start)
        self.sign, self.risk = sign, risk
        self.base = float(ordered[int(level * len(ordered))])
        self.excess = [float(v) for v in ordered[ordered > self.base] - self.base]
        self.limit = self.base

    def refit(self, seen: int) -> None:
        if not self.excess:
            return
        shape, scale = fit_tail(np.array(self.excess))
        ratio = seen * self.risk / len(self.excess)
        self.limit = self.base + (scale / shape * (ratio ** -shape - 1) if abs(shape) > 1e-12 else -scale * math.log(ratio))

    @property
    def threshold(self) -> float:
        return self.sign * self.limit


class Spot:
    """Adaptive thresholds. ``depth`` subtracts the mean of the last normal points (drift)."""

    def __init__(self, start: np.ndarray, risk: float = 1e-4, level: float = 0.98, depth: int = 0, both: bool = False):
        start = np.asarray(start, float)
        self.recent = [float(v) for v in start[-depth:]] if depth else []
        calibration = start
        if depth:
            means = np.convolve(start, np.ones(depth) / depth, mode="valid")
            calibration = start[depth:] - means[:-1]
        self.seen = len(calibration)
        self.sides = [Side(sign, calibration, level, risk) for sign in ((1, -1) if both else (1,))]
        for side in self.sides:
            side.refit(self.seen)

    def step(self, value: float) -> tuple[float, float | None, bool]:
        """Upper threshold, lower threshold or None, and whether the value is an alarm."""
        centre = sum(self.recent) / len(self.recent) if self.recent else 0.0
        x = value - centre
        alarm = False
        for side in self.sides:
            if side.sign * x > side.limit:
                alarm = True
                break
            if side.sign * x > side.base:
                side.excess.append(side.sign * x - side.base)
                self.seen += 1
                side.refit(self.seen)
                break
        else:
            self.seen += 1
        if not alarm and self.recent:
            self.recent = [*self.recent[1:], value]
        limits = [side.threshold + centre for side in self.sides]
        return limits[0], (limits[1] if len(limits) > 1 else None), alarm
