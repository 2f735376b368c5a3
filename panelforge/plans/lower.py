"""Node -> Column. The missing-value policy lives here and nowhere else:

missing is NULL (never NaN), infinities are kept, a comparison with a missing side is
false, and division is IEEE except that NaN is NULL. Nothing here depends on the
session's ANSI setting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from panelforge.expr import Node

INF = float("inf")


def null() -> Column:
    return F.lit(None).cast("double")


def clean(x: Column) -> Column:
    return F.nanvl(x, null())


def at_digits(x: Column, digits: int | None) -> Column:
    """What comparisons see: numbers that agree to so many decimals are ties."""
    return x if digits is None else F.rint(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def divide(a: Column, b: Column) -> Column:
    # -0.0 ** -1 is -inf: the sign of a zero counts, as in IEEE division.
    at_zero = F.when(a != 0, a * F.pow(b, F.lit(-1.0)))
    return clean(F.when(b == 0, at_zero).otherwise(F.try_divide(a, b)))


def _log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF))


def _pow(b: Column, y: Column) -> Column:
    zero = F.when(y > 0, F.lit(0.0)).when(y < 0, F.lit(INF))
    return clean(F.when(b > 0, F.pow(b, y)).when(b == 0, zero))


def _compare(how: Callable) -> Callable:
    return lambda a, b: F.coalesce(how(a, b), F.lit(False))


ELEM: dict[str, Callable[..., Column]] = {
    "add": lambda a, b: clean(a + b),
    "sub": lambda a, b: clean(a - b),
    "mul": lambda a, b: clean(a * b),
    "div": divide,
    "max": lambda a, b: F.when(a > b, a).otherwise(b),
    "min": lambda a, b: F.when(a < b, a).otherwise(b),
    "gt": _compare(lambda a, b: a > b),
    "ge": _compare(lambda a, b: a >= b),
    "lt": _compare(lambda a, b: a < b),
    "le": _compare(lambda a, b: a <= b),
    "eq": _compare(lambda a, b: a == b),
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "not": lambda a: ~a,
    "abs": F.abs,
    "sqrt": lambda a: clean(F.sqrt(a)),
    "log": _log,
    "exp": F.exp,
    "sign": lambda a: F.signum(a) + F.lit(0.0),
    "select": lambda c, a, b: F.when(c, a).otherwise(b),
    "pow": _pow,
}

#: Element-wise operators whose column mentions an argument more than once.
SPELLS_TWICE = {"div", "max", "min", "log", "pow", "finite_or"}


#: Operators that compare: their numbers are taken at the plan's digits.
COMPARES = {"gt", "ge", "lt", "le", "eq", "sign", "rank", "ts_rank", "argmax", "argmin"}


def elementwise(node: Node, args: list[Column]) -> Column:
    if node.op == "user_elem":
        return clean(node.params[0](*args).cast("double"))
    if node.op == "finite_or":
        x = args[0]
        return F.when(x.isNull() | (F.abs(x) == INF), F.lit(node.params[0])).otherwise(x)
    if node.op == "powi":
        return clean(F.pow(args[0], F.lit(node.params[0])))
    return ELEM[node.op](*args)


class Frames:
    """The windows of a panel with instrument column ``sym`` and time column ``t``."""

    def __init__(self, sym: str, t: str, pos: str):
        self.rows = Window.partitionBy(sym).orderBy(t)
        self.cross = Window.partitionBy(t)
        self.pos = pos
        #: (width, aggregate) -> (name, column) of the step that is being lowered.
        self.pool: dict[tuple[int, str], tuple[str, Column]] = {}

    def last(self, w: int) -> Span:
        return Span(self, w)


class Span:
    """The last w rows: puts an aggregate over them into the pool, once however often it is
    asked for (Spark would compute each mention), and returns its column."""

    def __init__(self, frames: Frames, w: int):
        self.frames, self.w = frames, w

    def __call__(self, aggregate: Column) -> Column:
        pool = self.frames.pool
        name, _ = pool.setdefault((self.w, str(aggregate)), (f"_w{len(pool)}", aggregate.over(self.frames.rows.rowsBetween(-(self.w - 1), 0))))
        return F.col(name)


def full(w: int, frame, value: Column, *inputs: Column) -> Column:
    """``value`` where all w rows of the frame are there and no input is missing in them."""
    seen = inputs[0] if len(inputs) == 1 else F.when(inputs[0].isNotNull() & inputs[1].isNotNull(), F.lit(1))
    return F.when(frame(F.count(seen)) == w, value)


def look_back(node: Node, args: list[Column], fr: Frames) -> Column:
    op, w, x = node.op, node.params[0], args[0]
    frame, pos = fr.last(w), F.col(fr.pos)
    if op == "lag":
        return F.lag(x, w).over(fr.rows)
    if op in ("slope", "rsquare", "resi"):
        x = F.when(F.abs(x) != INF, x)
        if op == "rsquare":
            return F.when(frame(F.var_samp(x)) > 0, frame(F.regr_r2(x, pos)))
        slope = frame(F.regr_slope(x, pos))
        return slope if op == "slope" else x - (slope * pos + frame(F.regr_intercept(x, pos)))
    if op in ("cov", "corr"):
        y = args[1]
        cov = frame(F.covar_samp(x, y))
        if op == "corr":
            vx, vy = frame(F.var_samp(x)), frame(F.var_samp(y))  # nothing is missing where the result counts
            cov = F.when((vx > 0) & (vy > 0), F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))
        return clean(full(w, frame, cov, x, y))
    if op == "reduce":
        return _fold(args, w, frame, node.params)
    if op in _STRICT:
        return clean(full(w, frame, _STRICT[op](x, w, frame, pos, node.params), x))
    raise ValueError(f"unknown windowed operator {op}")


def _ts_rank(x, w, frame, pos, params):
    a = frame(F.collect_list(x))
    less, same = F.size(F.filter(a, lambda v: v < x)), F.size(F.filter(a, lambda v: v == x))
    return less + (same + 1) / F.lit(2.0)


def _drawdown(x, w, frame, pos, params):
    a = frame(F.collect_list(x))
    peak = F.array_max(a)
    trough = F.array_min(F.slice(a, F.array_position(a, peak).cast("int"), F.lit(w)))
    return divide(peak - trough, peak)


def _fold(args, w, frame, params):
    """merge(acc, x) for one input; merge(acc, index, x, y, ...) with an index or more inputs."""
    _, merge, zero, finish, indexed = params
    row = F.struct(*[a.alias(f"x{i}") for i, a in enumerate(args)])
    rows = F.transform(frame(F.collect_list(row)), lambda r, i: F.struct(i.alias("i"), r.alias("r")))
    rest = lambda e: [e["r"][f"x{k}"] for k in range(len(args))]
    step = (lambda acc, e: merge(acc, e["i"], *rest(e))) if indexed else (lambda acc, e: merge(acc, *rest(e)))
    whole = F.lit(True)
    for a in args:
        whole = whole & (frame(F.count(a)) == w)
    return clean(F.when(whole, F.aggregate(rows, F.lit(zero), step, finish)))


def _decay(x, w, frame, pos, params):
    weighted = frame(F.sum(x * pos)) - (pos - w) * frame(F.sum(x))
    return weighted / F.lit(w * (w + 1) / 2)


_STRICT: dict[str, Callable] = {
    "sum": lambda x, w, fr, pos, p: fr(F.sum(x)),
    "avg": lambda x, w, fr, pos, p: fr(F.avg(x)),
    "product": lambda x, w, fr, pos, p: fr(F.product(x)),
    "wmin": lambda x, w, fr, pos, p: fr(F.min(x)),
    "wmax": lambda x, w, fr, pos, p: fr(F.max(x)),
    "var": lambda x, w, fr, pos, p: fr(F.var_samp(x)),
    "std": lambda x, w, fr, pos, p: fr(F.stddev_samp(x)),
    "skew": lambda x, w, fr, pos, p: fr(F.skewness(x)) * F.lit((w * (w - 1)) ** 0.5 / (w - 2)),
    "kurt": lambda x, w, fr, pos, p: ((w + 1) * fr(F.kurtosis(x)) + 6) * F.lit((w - 1) / ((w - 2) * (w - 3))),
    "argmax": lambda x, w, fr, pos, p: fr(F.max_by(pos, F.struct(x, -pos))) - (pos - w) + F.lit(0.0),
    "argmin": lambda x, w, fr, pos, p: fr(F.min_by(pos, F.struct(x, pos))) - (pos - w) + F.lit(0.0),
    "quantile": lambda x, w, fr, pos, p: fr(F.percentile(x, F.lit(p[1]))),
    "decay": _decay,
    "ts_rank": _ts_rank,
    "drawdown": _drawdown,
}
#: Operators that need the row number within the instrument.
NEEDS_POS = {"slope", "resi", "rsquare", "argmax", "argmin", "decay"}


def cross_section(node: Node, args: list[Column], fr: Frames) -> Column:
    x, all_rows = args[0], fr.cross
    if node.op == "rank":
        ordered = all_rows.orderBy(x.asc_nulls_last())
        ties = F.count(x).over(ordered.rangeBetween(0, 0))
        return F.when(x.isNotNull(), F.try_divide(F.rank().over(ordered) + (ties - 1) / F.lit(2.0), F.count(x).over(all_rows)))
    if node.op == "scale":
        return clean(divide(x, F.sum(F.abs(x)).over(all_rows)))
    if node.op == "diff_wsum":
        part = clean(x * args[1])
        return clean(F.when(F.count(part).over(all_rows) == F.count(F.lit(1)).over(all_rows), x - F.sum(part).over(all_rows)))
    return node.params[0](all_rows, *args)
