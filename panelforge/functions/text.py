"""A small text language for factors: Python expression syntax over named series.

``parse("rank(delta(close, 5)) * -1", {"close": Input("close")})`` gives a node. Only
arithmetic, comparisons, & | ~, numbers, names and calls of FUNCTIONS are accepted.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable

from panelforge import operators as op
from panelforge.expr import Node

FUNCTIONS: dict[str, Callable[..., Node]] = {
    "delay": op.BackRef,
    "delta": op.delta,
    "sum": op.WindowedSum,
    "mean": op.WindowedAvg,
    "std": op.WindowedStddev,
    "var": op.WindowedVar,
    "skew": op.WindowedSkew,
    "kurt": op.WindowedKurt,
    "product": op.WindowedProduct,
    "ts_min": op.WindowedMin,
    "ts_max": op.WindowedMax,
    "argmin": op.TsArgMin,
    "argmax": op.TsArgMax,
    "ts_rank": op.TsRank,
    "quantile": op.WindowedQuantile,
    "decay": op.DecayLinear,
    "drawdown": op.WindowedMaxDrawdown,
    "slope": op.WindowedLinearRegressionSlope,
    "rsquare": op.WindowedLinearRegressionRSqaure,
    "resi": op.WindowedLinearRegressionResi,
    "corr": lambda x, y, n: op.WindowedCorrelation(x, n, y),
    "cov": lambda x, y, n: op.WindowedCovariance(x, n, y),
    "ema": op.ExpMovingAvg,
    "rank": op.Rank,
    "scale": op.Scale,
    "log": op.Log,
    "exp": op.Exp,
    "sqrt": op.Sqrt,
    "abs": op.Abs,
    "sign": op.Sign,
    "pow": op.Pow,
    "max": op.Max,
    "min": op.Min,
    "clip": op.Clip,
    "where": op.Select,
    "flag": op.bool_to_10,
    "eq": op.Equals,
    "finite": op.SetInfOrNanToValue,
}

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.BitAnd: operator.and_, ast.BitOr: operator.or_}
_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


def parse(text: str, names: dict[str, Node | Callable]) -> Node:
    """The last statement's value; earlier lines of the form ``name = expression`` are local."""
    scope = dict(names)

    def value(e: ast.expr):
        match e:
            case ast.Constant(value=bool() | str()):
                raise SyntaxError(f"not a number: {e.value!r}")
            case ast.Constant(value=int() | float()):
                return e.value
            case ast.Name():
                if e.id not in scope:
                    raise NameError(f"unknown series {e.id!r}")
                return scope[e.id]
            case ast.UnaryOp(op=ast.USub()):
                return -value(e.operand)
            case ast.UnaryOp(op=ast.Invert()):
                return ~value(e.operand)
            case ast.BinOp() if type(e.op) in _BINARY:
                return _BINARY[type(e.op)](value(e.left), value(e.right))
            case ast.Compare(ops=[how]) if type(how) in _COMPARE:
                return _COMPARE[type(how)](value(e.left), value(e.comparators[0]))
            case ast.Call(func=ast.Name(id=f), keywords=[]):
                call = FUNCTIONS.get(f) or scope.get(f)
                if not callable(call):
                    raise NameError(f"unknown function {f!r}")
                return call(*map(value, e.args))
        raise SyntaxError(f"not allowed in a factor: {ast.unparse(e)}")

    result = None
    for line in ast.parse(text.strip()).body:
        match line:
            case ast.Assign(targets=[ast.Name(id=name)]):
                scope[name] = value(line.value)
            case ast.Expr():
                result = value(line.value)
            case _:
                raise SyntaxError("a line is an expression or name = expression")
    if not isinstance(result, Node):
        raise SyntaxError("a factor ends with an expression over series")
    return result
