"""Look-back windows: the last ``window`` rows of an instrument, the current one included.
All are strict (any missing value in the window gives a missing result), but for the
regressions, which use whatever rows the window has."""

from __future__ import annotations

from panelforge.expr import Node, windowed
from panelforge.operators.elem import Div, Sqrt

__all__ = ["BackRef", "DecayLinear", "TsArgMax", "TsArgMin", "TsRank", "WindowedAvg", "WindowedCorrelation", "WindowedCovariance", "WindowedKurt", "WindowedLinearRegressionRSqaure", "WindowedLinearRegressionResi", "WindowedLinearRegressionSlope", "WindowedMax", "WindowedMaxDrawdown", "WindowedMin", "WindowedProduct", "WindowedQuantile", "WindowedReduce", "WindowedSkew", "WindowedStddev", "WindowedSum", "WindowedVar", "delta", "returns"]


def _one(op: str, least: int = 1):
    def build(x, window: int) -> Node:
        return windowed(op, window, x, least=least)

    build.__name__ = op
    return build


BackRef = _one("lag")
WindowedSum, WindowedAvg, WindowedProduct, WindowedMin, WindowedMax = map(_one, ("sum", "avg", "product", "wmin", "wmax"))
WindowedVar, WindowedStddev = _one("var", 2), _one("std", 2)
WindowedSkew, WindowedKurt = _one("skew", 3), _one("kurt", 4)
TsArgMax, TsArgMin, TsRank, DecayLinear = map(_one, ("argmax", "argmin", "ts_rank", "decay"))
WindowedMaxDrawdown = _one("drawdown")
WindowedLinearRegressionSlope, WindowedLinearRegressionRSqaure, WindowedLinearRegressionResi = (_one(op, 2) for op in ("slope", "rsquare", "resi"))


def WindowedCovariance(x, window: int, y) -> Node:
    return windowed("cov", window, x, y, least=2)


def WindowedCorrelation(x, window: int, y) -> Node:
    return windowed("corr", window, x, y, least=2)


def WindowedQuantile(x, window: int, q: float) -> Node:
    if not 0 <= q <= 1:
        raise ValueError(f"a quantile lies in 0 to 1, got {q!r}")
    return windowed("quantile", window, x, params=(float(q),))


def WindowedReduce(x, window: int, merge, zero: float, finish=None, others: tuple = (), indexed: bool = False) -> Node:
    """A user fold over the window, oldest row first; ``merge`` and ``finish`` build Columns:
    merge(acc, x, *others), with ``indexed`` merge(acc, index, x, *others), the index being 0
    for the oldest row."""
    return windowed("reduce", window, x, *others, params=(merge, float(zero), finish, indexed))


def delta(x, window: int = 1) -> Node:
    return x - BackRef(x, window)


def returns(x, window: int = 1) -> Node:
    return x / BackRef(x, window) - 1
