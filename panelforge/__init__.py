"""Factor expressions over instrument x time panels, planned onto Spark DataFrames."""

from panelforge.expr import Const, Input, Node, Output
from panelforge.plans.compiler import FactorPlan, compile_factors

__all__ = ["Const", "FactorPlan", "Input", "Node", "Output", "compile_factors"]
