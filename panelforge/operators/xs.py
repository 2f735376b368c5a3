"""Cross-sectional operators: all instruments at one time."""

from __future__ import annotations

from panelforge.expr import Node, cross

__all__ = ["CrossSectional", "DiffWithWeightedSum", "Rank", "Scale"]


def Rank(x) -> Node:
    """Average-tie rank over the count of present values, in (0, 1]."""
    return cross("rank", x)


def Scale(x) -> Node:
    return cross("scale", x)


def DiffWithWeightedSum(value, weight) -> Node:
    """value - sum(value * weight); one missing product makes the whole row missing."""
    return cross("diff_wsum", value, weight)


def CrossSectional(build, *args) -> Node:
    """A user operator: ``build(window, *columns)`` returns a Column over a window that is
    partitioned by time."""
    return cross("user_xs", *args, params=(build,))
