"""Constructors of factor expressions: element-wise, windowed, recurrent, cross-sectional."""

from panelforge.operators.elem import *  # noqa: F403
from panelforge.operators.scan import *  # noqa: F403
from panelforge.operators.ts import *  # noqa: F403
from panelforge.operators.xs import *  # noqa: F403
