"""One trace at a time, as Python objects."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .errors import SignalNotPresent
from .functions.interpolation import method
from .operators import temporal
from .operators.align import is_table
from .operators.evaluate import evaluate, parse
from .sources.frames import from_trace, to_signal
from .sources.signals import BoolSignal, FloatSignal, Trace


def _evaluated(expr, trace: Trace, how: str, mode: str, spark: SparkSession | None, strict: bool):
    if how not in ("linear", "constant"):
        raise ValueError(f"interpolation is linear or constant, not {how!r}")
    expr = parse(expr)
    for name, kind in expr.variables().items():
        if trace.get(name, kind) is None:
            raise SignalNotPresent(name, kind.name)
    frame = from_trace(spark or SparkSession.builder.getOrCreate(), trace)
    return evaluate(expr, frame, how, mode, strict=strict)


def eval_robust_semantics(expr, trace: Trace, *, interpolation_method: str = "linear", mode: str = "documented", spark: SparkSession | None = None) -> FloatSignal:
    """How strongly a formula holds over a trace."""
    out = _evaluated(expr, trace, interpolation_method, mode, spark, False)
    if not is_table(out):
        return FloatSignal.constant(out, interpolation_method=interpolation_method)
    return to_signal(out, FloatSignal, interpolation_method=interpolation_method)


def eval_bool_semantics(expr, trace: Trace, *, interpolation_method: str = "linear", mode: str = "documented", spark: SparkSession | None = None) -> BoolSignal:
    """Whether a formula holds over a trace."""
    out = _evaluated(expr, trace, interpolation_method, mode, spark, mode == "documented")
    if not is_table(out):
        return BoolSignal.constant(out >= 0, interpolation_method=interpolation_method)
    return to_signal(temporal.as_truth(out, method(interpolation_method)), BoolSignal, interpolation_method=interpolation_method)
