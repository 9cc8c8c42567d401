"""Incremental twins of the time-series kernels: one value in, one out.

A state belongs to one symbol. A missing input (None or NaN) leaves it as it
is and gives None; the first result comes with observation ``lookback + 1``.
States are plain data: ``dump`` and ``load`` move them through a state store.
Each gives what the batch kernel of the same name gives.
"""

from __future__ import annotations

import json
import math
from collections import deque

from tidemark.functions.kernels import exponential_lookback


class State:
    """Base of all states."""

    lookback = 0

    def update(self, x: float | None) -> float | None:
        if x is None or x != x:
            return None
        return self._update(float(x))

    def _update(self, x: float) -> float | None:
        raise NotImplementedError

    def dump(self) -> str:
        return json.dumps(self._content())

    def load(self, text: str) -> State:
        self._restore(json.loads(text))
        return self

    def _content(self) -> object:
        raise NotImplementedError

    def _restore(self, content: object) -> None:
        raise NotImplementedError


class WindowState(State):
    """Keeps the last ``size`` observations and computes from them afresh.

    Nothing is added and subtracted over time, so no error builds up.
    """

    def __init__(self, size: int) -> None:
        if size < 1:
            raise ValueError(f"a window holds at least one observation, not {size}")
        self.size, self.lookback = size, size - 1
        self.values: deque[float] = deque(maxlen=size)

    def _update(self, x: float) -> float | None:
        self.values.append(x)
        return self._of(self.values) if len(self.values) == self.size else None

    def _of(self, values: deque[float]) -> float | None:
        raise NotImplementedError

    def _content(self) -> object:
        return list(self.values)

    def _restore(self, content: object) -> None:
        self.values = deque(content, maxlen=self.size)


class LagState(WindowState):
    def __init__(self, periods: int) -> None:
        super().__init__(periods + 1)

    def _of(self, values):
        return values[0]


class SimpleReturnState(WindowState):
    def __init__(self) -> None:
        super().__init__(2)

    def _update(self, x):
        if x <= 0:
            raise ValueError(f"a price must be above zero, not {x}")
        return super()._update(x)

    def _of(self, values):
        return values[1] / values[0] - 1.0


class LogReturnState(SimpleReturnState):
    def _of(self, values):
        return math.log(values[1] / values[0])


class RollingSumState(WindowState):
    def _of(self, values):
        return math.fsum(values)


class SmaState(WindowState):
    def _of(self, values):
        return math.fsum(values) / len(values)


class RollingStdState(WindowState):
    def __init__(self, size: int, ddof: int = 1) -> None:
        super().__init__(size)
        if not 0 <= ddof < size:
            raise ValueError(f"{ddof} degrees of freedom do not go with a window of {size}")
        self.ddof = ddof

    def _of(self, values):
        if max(values) == min(values):
            return 0.0
        mean = math.fsum(values) / len(values)
        return math.sqrt(math.fsum((v - mean) ** 2 for v in values) / (len(values) - self.ddof))


class HistoricalVolatilityState(RollingStdState):
    pass


class RollingZScoreState(RollingStdState):
    def _of(self, values):
        std = super()._of(values)
        return (values[-1] - math.fsum(values) / len(values)) / std if std else None


class EmaState(State):
    def __init__(self, alpha: float, tolerance: float = 1e-3) -> None:
        self.alpha, self.lookback = alpha, exponential_lookback(alpha, tolerance)
        self.mean, self.seen = 0.0, 0

    def _update(self, x):
        self.mean = x if self.seen == 0 else self.alpha * x + (1.0 - self.alpha) * self.mean
        self.seen += 1
        return self.mean if self.seen > self.lookback else None

    def _content(self):
        return [self.mean, self.seen]

    def _restore(self, content):
        self.mean, self.seen = content


class EwmaVolatilityState(EmaState):
    def _update(self, x):
        squared = super()._update(x * x)
        return None if squared is None else math.sqrt(squared)
