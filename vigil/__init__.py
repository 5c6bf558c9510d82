"""Monitoring of time-stamped data against Signal Temporal Logic, on Spark."""

import sys

from pyspark import cloudpickle

from .api import eval_bool_semantics, eval_robust_semantics
from .operators.evaluate import evaluate, numbers, robustness, satisfaction
from .plans.ast import (
    Abs, Add, Always, And, BoolExpr, Cmp, ConstBool, ConstFloat, ConstInt, ConstUInt, Div, Eventually, Expr, ExprBuilder, Interval, Mul, Negate, Next, Not, NumExpr, Or, Oracle, Ordering, Sub, Until, VarBool, VarFloat, VarInt, VarUInt,
)
from .plans.parser import parse_expr
from .sources.frames import TraceFrame, from_trace, read
from .sources.signals import BoolSignal, FloatSignal, IntSignal, Signal, Trace, UnsignedIntSignal
from .types import dtype

#: Functions that run on executors are pickled by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
__all__ = [
    "Abs", "Add", "Always", "And", "BoolExpr", "BoolSignal", "Cmp", "ConstBool", "ConstFloat", "ConstInt", "ConstUInt", "Div", "Eventually", "Expr", "ExprBuilder", "FloatSignal", "IntSignal", "Interval", "Mul", "Negate", "Next", "Not", "NumExpr", "Or", "Oracle", "Ordering",
    "Signal", "Sub", "Trace", "TraceFrame", "UnsignedIntSignal", "Until", "VarBool", "VarFloat", "VarInt", "VarUInt", "dtype", "eval_bool_semantics", "eval_robust_semantics", "evaluate", "from_trace", "numbers", "parse_expr", "read", "robustness", "satisfaction",
]
