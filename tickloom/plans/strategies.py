"""Strategies and fits in Python, as examples of the extension points."""

from __future__ import annotations

from collections import deque
from decimal import Decimal


class Crossing:
    """Long 100,000 while the mean of the last 3 mid closes is above that of the last 8; exact in decimals."""

    def __init__(self, fast: int = 3, slow: int = 8, units: float = 100_000.0):
        self.fast, self.slow, self.units = fast, slow, units
        self.closes: deque[Decimal] = deque(maxlen=slow)

    def on_bar(self, bar) -> float:
        self.closes.append(Decimal(str(round(bar.mid_close, 8))))
        if len(self.closes) < self.slow:
            return 0.0
        recent = list(self.closes)[-self.fast :]
        return self.units if self.slow * sum(recent) > self.fast * sum(self.closes) else 0.0


def mean_of(values: list[float]) -> float:
    return sum(values) / len(values)


def sign_of(mean: float, value: float) -> float:
    return float((value > mean) - (value < mean))
