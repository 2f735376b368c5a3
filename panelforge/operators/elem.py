"""Element-wise operators. Missing (NULL) and infinity rules live in the lowering."""

from __future__ import annotations

import math

from panelforge.expr import Const, Node, as_node, elem

__all__ = ["Abs", "Add", "AddConst", "And", "Clip", "Div", "DivConst", "Elementwise", "Equals", "Exp", "GreaterEqual", "GreaterThan", "GreaterThanConst", "LessEqual", "LessThan", "LessThanConst", "Log", "Max", "Min", "Mul", "MulConst", "Not", "Or", "Pow", "ReturnFirstValue", "Select", "SetInfOrNanToValue", "Sign", "Sqrt", "Sub", "SubConst", "bool_to_10"]


def _binary(op: str, boolean: bool = False):
    def build(a, b) -> Node:
        return elem(op, a, b, boolean=boolean)

    build.__name__ = op
    return build


def _unary(op: str):
    def build(a) -> Node:
        return elem(op, a)

    build.__name__ = op
    return build


def _const(op: str, boolean: bool = False):
    def build(a, value: float, swap: bool = False) -> Node:
        left, right = (value, a) if swap else (a, value)
        return elem(op, left, right, boolean=boolean)

    build.__name__ = f"{op}_const"
    return build


Add, Sub, Mul, Div = map(_binary, ("add", "sub", "mul", "div"))
#: The second operand is returned whenever the comparison is not true, also when one side is missing.
Max, Min = _binary("max"), _binary("min")
GreaterThan, GreaterEqual, LessThan, LessEqual, Equals = (_binary(op, True) for op in ("gt", "ge", "lt", "le", "eq"))
And, Or = _binary("and", True), _binary("or", True)
AddConst, SubConst, MulConst, DivConst = map(_const, ("add", "sub", "mul", "div"))
GreaterThanConst, LessThanConst = _const("gt", True), _const("lt", True)
Abs, Sqrt, Log, Exp, Sign = map(_unary, ("abs", "sqrt", "log", "exp", "sign"))


def Elementwise(build, *args) -> Node:
    """A user operator on one row: ``build(*columns)`` returns a Column of numbers."""
    return elem("user_elem", *args, params=(build,))


def Not(a) -> Node:
    return elem("not", a, boolean=True)


def Select(cond, a, b) -> Node:
    return elem("select", cond, a, b)


def SetInfOrNanToValue(a, value: float = 0.0) -> Node:
    return elem("finite_or", a, params=(float(value),))


def Clip(a, bound: float) -> Node:
    """Limits to [-bound, bound]; a missing value becomes ``bound`` (see Max and Min)."""
    return Max(Min(a, bound), -bound)


def ReturnFirstValue(first, *others) -> Node:
    """The first argument; the rest only order evaluation elsewhere, which a plan has no need of."""
    return as_node(first)


def bool_to_10(cond) -> Node:
    return Select(cond, 1.0, 0.0)


def Pow(base, expo) -> Node:
    base, expo = as_node(base), as_node(expo)
    if expo.op == "const" and expo.params[0] is not None:
        c = expo.params[0]
        if c == 0:
            return Const(1.0)
        if c == 1:
            return base
        if c < 0:
            return Div(1.0, Pow(base, -c))
        if c == 0.5:
            return Sqrt(base)
        if c == math.floor(c) and c <= 1024:
            return elem("powi", base, params=(c,))
        if 2 * c == math.floor(2 * c) and c <= 1024:
            return Mul(Sqrt(base), elem("powi", base, params=(c - 0.5,)))
    if base.op == "const" and base.params[0] == 1:
        return Const(1.0)
    if base.op == "const" and base.params[0] == math.e:
        return Exp(expo)
    return elem("pow", base, expo)
