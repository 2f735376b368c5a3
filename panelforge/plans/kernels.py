"""The operators on numpy arrays: one panel row an entry, missing is NaN.

Look-back kernels take the rows of several instruments one after the other; ``first`` is the
position of each row's instrument's first row. A window that reaches beyond it is missing (the
regressions use what is there). Cross-sectional kernels take whole time steps one after the
other; ``step`` numbers the time steps from 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view

#: Numbers of a windowed view that are worked on at once.
BLOCK = 1 << 21


def at_digits(x: np.ndarray, digits: int | None) -> np.ndarray:
    """What comparisons see: numbers that agree to so many decimals are ties."""
    if digits is None:
        return x
    scale = 10.0**digits
    return np.rint(x * scale) / scale


# -- element-wise ------------------------------------------------------------------------


def power(b: np.ndarray, y) -> np.ndarray:
    """The C library's, to the last bit; numpy's own differs on some machines."""
    return pc.power(pa.array(b, pa.float64()), pa.array(y, pa.float64()) if isinstance(y, np.ndarray) else float(y)).to_numpy(zero_copy_only=False)


def _pow(b: np.ndarray, y: np.ndarray) -> np.ndarray:
    at_zero = np.where(y > 0, 0.0, np.where(y < 0, np.inf, np.nan))
    return np.where(b > 0, power(np.where(b > 0, b, 1.0), y), np.where(b == 0, at_zero, np.nan))


ELEM: dict[str, Callable[..., np.ndarray]] = {
    "add": np.add, "sub": np.subtract, "mul": np.multiply, "div": np.divide,
    "max": lambda a, b: np.where(a > b, a, b), "min": lambda a, b: np.where(a < b, a, b),
    "gt": np.greater, "ge": np.greater_equal, "lt": np.less, "le": np.less_equal, "eq": np.equal,
    "and": np.logical_and, "or": np.logical_or, "not": np.logical_not,
    "abs": np.abs, "sqrt": np.sqrt, "log": np.log, "exp": np.exp, "sign": lambda a: np.sign(a) + 0.0,
    "select": lambda c, a, b: np.where(c, a, b), "pow": _pow,
}
#: Operators that compare: their numbers are taken at the plan's digits.
COMPARES = {"gt", "ge", "lt", "le", "eq", "sign", "rank", "ts_rank", "argmax", "argmin"}


def elementwise(op: str, params: tuple, args: list[np.ndarray]) -> np.ndarray:
    if op == "finite_or":
        return np.where(np.isfinite(args[0]), args[0], params[0])
    if op == "powi":
        return power(args[0], params[0])
    return ELEM[op](*args)


# -- look-back ---------------------------------------------------------------------------


def _view(x: np.ndarray, w: int) -> np.ndarray:
    return sliding_window_view(np.r_[np.full(w - 1, np.nan), x], w)


def _centred(v: np.ndarray) -> np.ndarray:
    """Each window less its mean; exactly 0 where all its numbers are equal."""
    d = v - v.mean(axis=1, keepdims=True)
    d[v.max(axis=1) == v.min(axis=1)] = 0.0
    return d


def _var(v, w, p):
    return (_centred(v) ** 2).sum(axis=1) / (w - 1)


def _skew(v, w, p):
    d = _centred(v)
    m2 = (d * d).mean(axis=1)
    m2[m2 == 0] = np.nan
    return (d**3).mean(axis=1) / m2**1.5 * ((w * (w - 1)) ** 0.5 / (w - 2))


def _kurt(v, w, p):
    d = _centred(v) ** 2
    m2 = d.mean(axis=1)
    m2[m2 == 0] = np.nan
    return ((w + 1) * ((d * d).mean(axis=1) / m2**2 - 3) + 6) * ((w - 1) / ((w - 2) * (w - 3)))


def _drawdown(v, w, p):
    at = v.argmax(axis=1)[:, None]
    peak = np.take_along_axis(v, at, 1)[:, 0]
    after = np.where(np.arange(w) >= at, v, np.inf)
    return (peak - after.min(axis=1)) / peak


def _quantile(v, w, p):
    s, k = np.sort(v, axis=1), p[1] * (w - 1)
    lo = int(np.floor(k))
    hi = min(lo + 1, w - 1)
    return s[:, lo] + (s[:, hi] - s[:, lo]) * (k - lo) if k > lo else s[:, lo].copy()


#: Strict windows of one input: (windows, width, parameters) -> results.
STRICT: dict[str, Callable] = {
    "sum": lambda v, w, p: v.sum(axis=1),
    "avg": lambda v, w, p: v.mean(axis=1),
    "product": lambda v, w, p: v.prod(axis=1),
    "wmin": lambda v, w, p: v.min(axis=1),
    "wmax": lambda v, w, p: v.max(axis=1),
    "var": _var,
    "std": lambda v, w, p: np.sqrt(_var(v, w, p)),
    "skew": _skew,
    "kurt": _kurt,
    "argmax": lambda v, w, p: v.argmax(axis=1) + 1.0,
    "argmin": lambda v, w, p: v.argmin(axis=1) + 1.0,
    "ts_rank": lambda v, w, p: (v < v[:, -1:]).sum(axis=1) + ((v == v[:, -1:]).sum(axis=1) + 1) / 2.0,
    "decay": lambda v, w, p: (v * np.arange(1.0, w + 1)).sum(axis=1) / (w * (w + 1) / 2),
    "quantile": _quantile,
    "drawdown": _drawdown,
}


def _pair(op: str, a: np.ndarray, b: np.ndarray, w: int) -> np.ndarray:
    da, db = _centred(a), _centred(b)
    cov = (da * db).sum(axis=1)
    if op == "cov":
        return cov / (w - 1)
    va, vb = (da * da).sum(axis=1), (db * db).sum(axis=1)
    return np.where((va > 0) & (vb > 0), cov / (np.sqrt(va) * np.sqrt(vb)), np.nan)


def _regression(op: str, v: np.ndarray, w: int, there: np.ndarray) -> np.ndarray:
    """Against 1..w over the finite numbers of each window; ``there``: rows it may use."""
    p = np.arange(1.0, w + 1)
    ok = np.isfinite(v) & (p > w - there[:, None])
    n = ok.sum(axis=1)
    x = np.where(ok, v, 0.0)
    mp, mx = (ok * p).sum(axis=1) / n, x.sum(axis=1) / n
    dp = np.where(ok, p - mp[:, None], 0.0)
    dx = np.where(ok, v - mx[:, None], 0.0)
    spp, spx = (dp * dp).sum(axis=1), (dp * dx).sum(axis=1)
    slope = np.where(spp > 0, spx / spp, np.nan)
    if op == "slope":
        return slope
    if op == "resi":
        last = np.where(ok[:, -1], v[:, -1], np.nan)
        return last - (slope * w + (mx - slope * mp))
    low, high = np.where(ok, v, np.inf).min(axis=1), np.where(ok, v, -np.inf).max(axis=1)
    sxx = (dx * dx).sum(axis=1)
    return np.where((high > low) & (spp > 0) & (sxx > 0), spx * spx / (spp * sxx), np.nan)


def look_back(op: str, params: tuple, args: list[np.ndarray], first: np.ndarray, start: int) -> np.ndarray:
    """Results for the rows from ``start`` on."""
    w, n = params[0], len(first)
    here = np.arange(start, n)
    there = here - first[start:] + 1  # rows of the instrument up to this one
    if op == "lag":
        return np.where(there > w, args[0][np.maximum(here - w, 0)], np.nan)
    out = np.empty(n - start)
    views = [_view(a[max(0, start - w + 1) :], w)[start - max(0, start - w + 1) :] for a in args]
    step = max(1, BLOCK // w)
    for i in range(0, n - start, step):
        v = [x[i : i + step] for x in views]
        if op in ("slope", "rsquare", "resi"):
            out[i : i + step] = _regression(op, v[0], w, there[i : i + step])
            continue
        gap = there[i : i + step] < w
        for x in v:
            gap |= np.isnan(x).any(axis=1)
        got = _pair(op, *v, w) if op in ("cov", "corr") else STRICT[op](v[0], w, params)
        out[i : i + step] = np.where(gap, np.nan, got)
    return out


# -- recurrences -------------------------------------------------------------------------

#: Rows of an exponential average that one product of matrices covers.
STRIDE = 64


def ema(x: np.ndarray, state: float, alpha: float) -> np.ndarray:
    """State after each row; missing rows leave it. A block of rows is one matrix product."""
    ok = ~np.isnan(x)
    seen = x[ok]
    out = np.empty(len(seen))
    at = 0
    if np.isnan(state) and len(seen):
        state = out[0] = seen[0]
        at = 1
    if np.isfinite(seen).all() and np.isfinite(state):
        keep = (1 - alpha) ** np.arange(STRIDE + 1)
        i = np.arange(STRIDE)
        matrix = np.where(i[:, None] >= i, alpha * keep[np.maximum(i[:, None] - i, 0)], 0.0)
        while at < len(seen):
            part = seen[at : at + STRIDE]
            k = len(part)
            out[at : at + k] = matrix[:k, :k] @ part + keep[1 : k + 1] * state
            state = out[at + k - 1]
            at += k
    else:
        for at in range(at, len(seen)):
            state = out[at] = state * (1 - alpha) + seen[at] * alpha
    # Rows before the first number that counts hold the state from before.
    before = np.cumsum(ok)
    return np.where(before > 0, out[np.maximum(before - 1, 0)] if len(out) else np.nan, np.nan)


# -- cross-sections ----------------------------------------------------------------------


def rank(x: np.ndarray, step: np.ndarray) -> np.ndarray:
    by = np.lexsort((x, step))
    xs, ss = x[by], step[by]
    n = len(x)
    new_step = np.r_[True, ss[1:] != ss[:-1]]
    fresh = new_step | np.r_[True, xs[1:] != xs[:-1]]
    head = np.flatnonzero(fresh)
    run = np.cumsum(fresh) - 1
    size = np.diff(np.r_[head, n])
    base = np.flatnonzero(new_step)[np.cumsum(new_step) - 1]
    place = head[run] - base + 1 + (size[run] - 1) / 2.0
    count = np.bincount(step, weights=~np.isnan(x))
    out = np.empty(n)
    out[by] = np.where(np.isnan(xs), np.nan, place / np.maximum(count[ss], 1))
    return out


def cross_section(op: str, args: list[np.ndarray], step: np.ndarray) -> np.ndarray:
    x = args[0]
    if op == "rank":
        return rank(x, step)
    heads = np.flatnonzero(np.r_[True, step[1:] != step[:-1]])
    if op == "scale":
        return x / np.add.reduceat(np.abs(np.where(np.isnan(x), 0.0, x)), heads)[step]
    return x - np.add.reduceat(x * args[1], heads)[step]  # diff_wsum: one NaN is all NaN
