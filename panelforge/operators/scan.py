"""Operators that depend on the whole history of an instrument."""

from __future__ import annotations

import math

from panelforge.expr import Node, scan

__all__ = ["Accumulate", "ExpMovingAvg", "Scan"]

Scan = scan


class _Ema:
    def __init__(self, window: int):
        self.alpha = 2.0 / (window + 1)

    def __eq__(self, other) -> bool:
        return isinstance(other, _Ema) and other.alpha == self.alpha

    def __hash__(self) -> int:
        return hash(("ema", self.alpha))

    def __call__(self, state: float, x: float) -> tuple[float, float]:
        if not math.isnan(x):
            state = x if math.isnan(state) else state * (1 - self.alpha) + x * self.alpha
        return state, state


def ExpMovingAvg(x, window: int, init: Node | None = None) -> Node:
    """v = v(1-a) + xa with a = 2/(window+1). The first present value seeds it (or ``init``,
    one value per instrument); a missing input repeats the last result."""
    if window < 1:
        raise ValueError("the window must be at least 1")
    return scan(_Ema(window), x, init=math.nan, initial=init, label="ema")


class _Register:
    def __init__(self, update):
        self.update = update

    def __eq__(self, other) -> bool:
        return isinstance(other, _Register) and other.update is self.update

    def __hash__(self) -> int:
        return hash(id(self.update))

    def __call__(self, state, *row):
        mask, value = self.update(state, *row)
        state = value if mask else state
        return state, state


def Accumulate(update, *args, init: float = 0.0) -> Node:
    """A named register carried over time: ``update(acc, *row)`` gives (mask, value), and the
    register takes the value where the mask is true. The result is the register after the row."""
    return scan(_Register(update), *args, init=init, label="accumulate")
