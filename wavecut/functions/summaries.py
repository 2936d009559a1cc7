"""Mergeable summaries of values: central moments and a quantile sketch with a counted rank error."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Moments:
    """Count, mean and the sums of the second to fourth powers around it, and the largest value."""

    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    m3: float = 0.0
    m4: float = 0.0
    top: float = -np.inf

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        if not len(x):
            return cls()
        mean = float(x.mean())
        d = x - mean
        return cls(len(x), mean, float((d**2).sum()), float((d**3).sum()), float((d**4).sum()), float(x.max()))

    def merge(self, other: Moments) -> Moments:
        """Pairwise update of the powers."""
        a, b, n = self.n, other.n, self.n + other.n
        if not a or not b:
            return other if not a else self
        d = other.mean - self.mean
        m2 = self.m2 + other.m2 + d**2 * a * b / n
        m3 = self.m3 + other.m3 + d**3 * a * b * (a - b) / n**2 + 3 * d * (a * other.m2 - b * self.m2) / n
        m4 = (
            self.m4 + other.m4 + d**4 * a * b * (a * a - a * b + b * b) / n**3
            + 6 * d**2 * (a * a * other.m2 + b * b * self.m2) / n**2 + 4 * d * (a * other.m3 - b * self.m3) / n
        )
        return Moments(n, self.mean + d * b / n, m2, m3, m4, max(self.top, other.top))

    def stats(self) -> list[float | None]:
        """Mean, sample deviation, population skewness, excess kurtosis, maximum; None where undefined."""
        n = self.n
        if not n:
            return [None] * 5
        flat = self.m2 <= 0
        return [
            self.mean, float(np.sqrt(self.m2 / (n - 1))) if n > 1 else None,
            None if flat else float(np.sqrt(n) * self.m3 / self.m2**1.5), None if flat else n * self.m4 / self.m2**2 - 3, self.top,
        ]

    def state(self) -> list[float]:
        return [self.mean, self.m2, self.m3, self.m4, self.top]


@dataclass
class QuantileSketch:
    """Values by level; one of level h stands for 2**h of the signal's.

    A full level is sorted and every second value moves up, which shifts the rank of any value by 2**h at most;
    ``error`` adds these up, so the rank error of a sketch is known, not estimated.  Nothing moves up while a
    signal has no more than ``size`` values: its quantiles are exact.  With n values the error is about
    (n / size) * log2(n / size).
    """

    size: int = 2048
    levels: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0)])
    error: int = 0

    def add(self, x: np.ndarray) -> None:
        for at in range(0, len(x), self.size):
            self.levels[0] = np.concatenate([self.levels[0], x[at:at + self.size]])
            self._shrink()

    def merge(self, other: QuantileSketch) -> None:
        self.error += other.error
        for h, values in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(np.zeros(0))
            self.levels[h] = np.concatenate([self.levels[h], values])
        self._shrink()

    def _shrink(self) -> None:
        h = 0
        while h < len(self.levels):
            if len(self.levels[h]) > self.size:
                values = np.sort(self.levels[h])
                even = len(values) - len(values) % 2
                if h + 1 == len(self.levels):
                    self.levels.append(np.zeros(0))
                # low and high neighbours in turn, so that errors do not add up one way
                first = (self.error >> h) % 2
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], values[first:even:2]])
                self.levels[h] = values[even:]
                self.error += 1 << h
            h += 1

    def quantiles(self, fractions: Sequence[float], absolute: bool = False) -> list[float | None]:
        """Interpolated like an exact percentile; of absolute values the rank error is twice ``error``."""
        values = np.concatenate(self.levels)
        if not len(values):
            return [None] * len(fractions)
        weights = np.repeat(1 << np.arange(len(self.levels)), [len(v) for v in self.levels])
        values = np.abs(values) if absolute else values
        order = np.argsort(values, kind="stable")
        values, ends = values[order], np.cumsum(weights[order])
        at = np.asarray(fractions) * (ends[-1] - 1)
        low, high = (values[np.searchsorted(ends, f(at), "right").clip(max=len(values) - 1)] for f in (np.floor, np.ceil))
        return (low + (high - low) * (at - np.floor(at))).tolist()

    def state(self) -> tuple[list[float], list[int]]:
        return np.concatenate(self.levels).tolist(), [len(v) for v in self.levels]

    @classmethod
    def restore(cls, size: int, values: Sequence[float], lengths: Sequence[int], error: int) -> QuantileSketch:
        parts = np.split(np.asarray(values, dtype=float), np.cumsum(lengths)[:-1]) if len(lengths) else [np.zeros(0)]
        return cls(size, parts, int(error))
