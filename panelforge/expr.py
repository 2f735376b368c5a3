"""Immutable, hash-consed factor expressions.

A node is (op, children, parameters). Building the same expression twice gives
the same object, so common sub-expressions are shared across all factors of a
plan. Kinds decide where a node may run:

* ``in``/``const``/``elem``: same instrument and time, a plain Column
* ``ts``: a look-back window over one instrument
* ``scan``: depends on all earlier rows of one instrument
* ``xs``: all instruments at one time
"""

from __future__ import annotations

import math
import weakref
from collections.abc import Callable
from typing import Any

_POOL: weakref.WeakValueDictionary = weakref.WeakValueDictionary()


class Node:
    __slots__ = ("__weakref__", "args", "boolean", "kind", "op", "params")

    op: str
    kind: str
    args: tuple["Node", ...]
    params: tuple
    boolean: bool

    def __new__(cls, op: str, kind: str, args: tuple = (), params: tuple = (), boolean: bool = False):
        key = (op, kind, tuple(map(id, args)), params)
        if (found := _POOL.get(key)) is not None:
            return found
        self = object.__new__(cls)
        self.op, self.kind, self.args, self.params, self.boolean = op, kind, args, params, boolean
        _POOL[key] = self
        return self

    def __reduce__(self):
        return (Node, (self.op, self.kind, self.args, self.params, self.boolean))

    def __repr__(self) -> str:
        inner = [repr(a) for a in self.args] + [repr(p) for p in self.params if not callable(p)]
        return f"{self.op}({', '.join(inner)})" if self.op != "input" else str(self.params[0])

    def _with(self, op: str, other: Any, swap: bool = False, boolean: bool = False) -> "Node":
        a, b = (as_node(other), self) if swap else (self, as_node(other))
        return elem(op, a, b, boolean=boolean)

    __add__ = lambda self, o: self._with("add", o)
    __radd__ = lambda self, o: self._with("add", o, True)
    __sub__ = lambda self, o: self._with("sub", o)
    __rsub__ = lambda self, o: self._with("sub", o, True)
    __mul__ = lambda self, o: self._with("mul", o)
    __rmul__ = lambda self, o: self._with("mul", o, True)
    __truediv__ = lambda self, o: self._with("div", o)
    __rtruediv__ = lambda self, o: self._with("div", o, True)
    __gt__ = lambda self, o: self._with("gt", o, boolean=True)
    __ge__ = lambda self, o: self._with("ge", o, boolean=True)
    __lt__ = lambda self, o: self._with("lt", o, boolean=True)
    __le__ = lambda self, o: self._with("le", o, boolean=True)
    __and__ = lambda self, o: self._with("and", o, boolean=True)
    __or__ = lambda self, o: self._with("or", o, boolean=True)
    __invert__ = lambda self: elem("not", self, boolean=True)
    __neg__ = lambda self: as_node(0.0) - self


def elem(op: str, *args: Any, params: tuple = (), boolean: bool = False) -> Node:
    nodes = tuple(as_node(a) for a in args)
    logical = op in ("and", "or", "not")
    for i, n in enumerate(nodes):
        wants = logical or (op == "select" and i == 0)
        if wants != n.boolean:
            raise TypeError(f"{op}: argument {i} must be {'a condition' if wants else 'a number'}, got {n!r}")
    if op in ("add", "mul", "and", "or"):  # commutative; never max and min
        nodes = tuple(sorted(nodes, key=id)) if nodes[0] is not nodes[1] else nodes
    return Node(op, "elem", nodes, params, boolean)


def windowed(op: str, window: int, *args: Any, params: tuple = (), least: int = 1) -> Node:
    if isinstance(window, bool) or int(window) != window or window < least:
        raise ValueError(f"{op}: the window must be a whole number of at least {least}, got {window!r}")
    return Node(op, "ts", _numbers(op, args), (int(window), *params))


def cross(op: str, *args: Any, params: tuple = ()) -> Node:
    return Node(op, "xs", _numbers(op, args), params)


def _numbers(op: str, args: tuple) -> tuple[Node, ...]:
    nodes = tuple(as_node(a) for a in args)
    if any(n.boolean for n in nodes):
        raise TypeError(f"{op} takes numbers, not conditions")
    return nodes


def as_node(value: Any) -> Node:
    return value if isinstance(value, Node) else Const(value)


def Const(value: float | int | str) -> Node:
    """A literal; missing is written 'nan', infinities are allowed."""
    if value == "nan":
        return Node("const", "const", (), (None,))
    value = float(value)
    if math.isnan(value):
        raise ValueError("write a missing constant as 'nan'")
    return Node("const", "const", (), (value,) if value or math.copysign(1.0, value) > 0 else (value, "-"))


def Input(name: str) -> Node:
    return Node("input", "in", (), (name,))


def InitialValue(name: str) -> Node:
    """One value per instrument, from the ``initial`` table of a run."""
    return Node("initial", "in", (), (name,))


class Output:
    """A named result; names are checked when a plan is compiled."""

    def __init__(self, node: Node, name: str):
        self.node, self.name = as_node(node), name


def scan(step: Callable, *args: Any, init: float | None = None, initial: Node | None = None, label: str = "scan") -> Node:
    """A user recurrence: ``state, out = step(state, *row)`` in time order for each
    instrument. Missing numbers reach ``step`` as NaN; a NaN out is missing."""
    nodes = tuple(as_node(a) for a in args)
    return Node(label, "scan", nodes + ((initial,) if initial is not None else ()), (step, init, initial is not None))


def walk(roots: list[Node]) -> list[Node]:
    """Children before parents, each node once, without recursion."""
    done: dict[int, Node] = {}
    stack = [(n, False) for n in reversed(roots)]
    while stack:
        node, ready = stack.pop()
        if id(node) in done:
            continue
        if ready:
            done[id(node)] = node
        else:
            stack.append((node, True))
            stack.extend((a, False) for a in reversed(node.args))
    return list(done.values())
