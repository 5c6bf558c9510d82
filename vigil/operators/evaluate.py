"""Formulas over trace frames.

Nodes compile on the driver, each distinct one once.  ``exact`` follows signals between their samples: what needs no other times than
the rows of an aligned frame stays a projection (a Point), everything else is a signal table.  ``samples`` looks at samples only and is one chain of windows over a single
partitioning by trace.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import MonitorError
from ..functions import numeric
from ..functions.interpolation import Method, method
from ..functions.numeric import HAIR, INF
from ..plans import ast
from ..plans.ast import Interval, Ordering
from ..sources.frames import TraceFrame
from ..types import dtype
from . import align, temporal

MODES, GRIDS = ("documented", "observed"), ("exact", "samples")


@dataclass
class Point:
    """A signal at the rows of an aligned frame; jumps: it takes infinite values only."""

    column: Column
    jumps: bool = False


def _fold(f):
    """f of plain numbers, errors of NaN kept apart."""

    def folded(a, b):
        out = f(a, b)
        if out != out:
            raise MonitorError("a constant expression is not a number")
        return out

    return folded


def _divide(a: float, b: float) -> float:
    if b:
        return a / b
    sign = -1.0 if str(b).startswith("-") else 1.0
    return float("nan") if not a or a != a else (INF if a > 0 else -INF) * sign


_ARITHMETIC = {ast.Add: (lambda a, b: a + b, lambda a, b: a + b, False), ast.Mul: (lambda a, b: a * b, lambda a, b: a * b, False), ast.Sub: (lambda a, b: a - b, lambda a, b: a - b, True), ast.Div: (numeric.divide, _divide, True)}


class Exact:
    def __init__(self, frame: TraceFrame, how: Method, mode: str, strict: bool):
        self.frame, self.how, self.mode, self.strict = frame, how, mode, strict
        self.done: dict = {}

    def table(self, x):
        """x as a table or a constant."""
        return self.frame.rows.select("trace", "t", x.column.alias("v")) if isinstance(x, Point) else x

    def of(self, node: ast.Expr):
        """Point, table, or constant (a float); robustness for formulas."""
        key = node.key()
        if key not in self.done:
            self.done[key] = self.number(node) if node.is_numeric else self.formula(node)
        return self.done[key]

    def variable(self, node):
        f = self.frame
        f.has(node.name, node.kind)
        if node.name in f.constants:
            v = f.constants[node.name][0]
            return (INF if v else -INF) if node.kind is dtype.bool_ else float(v)
        read = numeric.truth if node.kind is dtype.bool_ else lambda c: c.cast("double")
        if f.aligned:
            return Point(read(F.col(f.places[node.name])), node.kind is dtype.bool_)
        return f.table(node.name, node.kind).select("trace", "t", read(F.col("v")).alias("v"))

    def unary(self, x, f, g):
        return Point(f(x.column), x.jumps) if isinstance(x, Point) else align.unary(x, f, g)

    def binary(self, x, y, f, g, cross: bool, *, plain: bool = False):
        """plain: f is linear in x and y, so that no times are needed beside theirs."""
        points = [z for z in (x, y) if isinstance(z, Point)]
        if points and all(isinstance(z, (Point, float)) for z in (x, y)):
            a, b = (z.column if isinstance(z, Point) else F.lit(z) for z in (x, y))
            jumps = all(z.jumps if isinstance(z, Point) else abs(z) == INF for z in (x, y))
            if plain or not cross or jumps or self.how.name != "linear":
                return Point(f(a, b), jumps)
            rows = self.frame.rows.select("trace", "t", a.alias("a"), b.alias("b"))
            return align.crossings(rows, F.col("a"), F.col("b"), self.how).select("trace", "t", f(F.col("a"), F.col("b")).alias("v"))
        return self.aligned(self.table(x), self.table(y), f, g, cross)

    def aligned(self, x, y, f, g, cross: bool):
        return align.binary(x, y, f, g, self.how, cross, self.frame.parts() if align.is_table(x) and align.is_table(y) else None)

    def number(self, node):
        if isinstance(node, ast._ConstNum):
            return float(node.value)
        if isinstance(node, ast.VarNum):
            return self.variable(node)
        args = [self.of(a) for a in node.args]
        if isinstance(node, ast.Negate):
            return self.unary(args[0], lambda c: -c, lambda v: -v)
        if isinstance(node, ast.Abs):
            return self.unary(args[0], F.abs, abs)
        f, g, cross = _ARITHMETIC[type(node)]
        out = args[0]
        for x in args[1:]:
            out = self.binary(out, x, f, _fold(g), cross, plain=isinstance(node, ast.Sub))
        return out

    def compare(self, node):
        x, y = map(self.of, node.args)
        op = node.op
        if op in (Ordering.eq, Ordering.ne):
            sign = 1.0 if op is Ordering.ne and self.mode == "documented" else -1.0
            f, g = (lambda a, b: F.abs(a - b) * sign), (lambda a, b: abs(a - b) * sign)
        elif op in (Ordering.lt, Ordering.le):
            f, g = (lambda a, b: b - a), (lambda a, b: b - a)
        else:
            f, g = (lambda a, b: a - b), (lambda a, b: a - b)
        if self.strict and op.strict and self.mode == "documented":
            inner, inner_g = f, g
            f = lambda a, b: F.when(a == b, F.lit(HAIR)).otherwise(inner(a, b))
            g = lambda a, b: HAIR if a == b else inner_g(a, b)
        return self.binary(x, y, f, _fold(g), True, plain=op not in (Ordering.eq, Ordering.ne))

    def formula(self, node):
        if isinstance(node, ast.ConstBool):
            return INF if node.value else -INF
        if isinstance(node, ast.VarBool):
            return self.variable(node)
        if isinstance(node, ast.Cmp):
            return self.compare(node)
        args = [self.of(a) for a in node.args]
        if isinstance(node, ast.Not):
            return self.unary(args[0], lambda c: -c, lambda v: -v)
        if isinstance(node, (ast.And, ast.Or)):
            f, g = (F.least, min) if isinstance(node, ast.And) else (F.greatest, max)
            out = args[0]
            for x in sorted(args[1:], key=lambda x: not isinstance(x, (Point, float))):
                out = self.binary(out, x, f, g, True)
            return out
        if isinstance(node, (ast.Next, ast.Oracle)):
            return self.next(args[0], node.steps)
        if isinstance(node, ast.Until):
            return self.until(*args, node.interval)
        return self.window(args[0], "F" if isinstance(node, ast.Eventually) else "G", node.interval)

    def next(self, x, steps: int):
        x = self.table(x)
        if not align.is_table(x):
            return x
        if self.mode == "observed":
            if steps == 0:
                return x.limit(0)
            n = F.count("*").over(Window.partitionBy("trace"))
            fine = F.when((n > steps) & (n != 2 * steps), F.raise_error(F.lit("the observed shift takes twice as many samples as steps"))).otherwise(F.col("t"))
            x = x.withColumn("t", fine)
        return temporal.oracle(x, steps)

    def window(self, x, kind: str, interval: Interval):
        interval.checked()
        x = self.table(x)
        if not align.is_table(x):
            return x
        if interval.untimed:
            return temporal.untimed(x, kind, self.how)
        if self.mode == "documented":
            return temporal.timed(x, kind, interval, self.how, self.frame.parts())
        return self.observed(x, kind, interval)

    def observed(self, x: DataFrame, kind: str, interval: Interval) -> DataFrame:
        """The end of the interval matters only where it is longer than the trace; there the trace keeps its own times."""
        a, b = interval.a, interval.b
        shifted = temporal.shift_left(x, a, self.how) if a else x
        if b is None:
            return temporal.untimed(shifted, kind, self.how)
        short = align.bounds(x).where(F.col("end") - F.col("start") < b - a).select("trace")
        few = x.join(short, "trace", "left_semi")
        own = align.interpolate_at(shifted, few.select("trace", "t"), self.how) if a else few
        return temporal.untimed(shifted.join(short, "trace", "left_anti"), kind, self.how).unionByName(temporal.untimed(own, kind, self.how))

    def until(self, x, y, interval: Interval):
        interval.checked()
        x, y = self.table(x), self.table(y)
        if not align.is_table(x) and not align.is_table(y):
            return min(x, y)
        if not align.is_table(x):
            x = y.select("trace", "t", F.lit(x).alias("v"))
        flat = y if not align.is_table(y) else None
        if flat is not None:
            y = x.select("trace", "t", F.lit(y).alias("v"))
        z = temporal.until(x, y, self.how, self.frame.parts())
        if self.mode == "observed":
            z = temporal.without_runs(z)
        if interval.untimed:
            return z
        soon = self.window(y if flat is None else flat, "F", interval)
        if interval.a:
            z = self.window(z, "G", Interval(0, interval.a / 1e9))
        return self.aligned(soon, z, F.least, min, True)


class Samples:
    """Nodes become columns of one frame; values between samples are not looked at."""

    def __init__(self, frame: TraceFrame, strict: bool, wide: bool):
        if not frame.aligned:
            raise ValueError("the samples grid takes a frame whose signals share their times (aligned=True)")
        self.frame, self.strict, self.wide, self.df, self.n = frame, strict, wide, frame.rows, 0
        self.exact = Exact(frame, method("constant"), "documented", strict)
        self.done: dict = {}

    def named(self, c: Column) -> Column:
        self.n += 1
        self.df = self.df.withColumn(f"n{self.n}", c)
        return F.col(f"n{self.n}")

    def of(self, node) -> Column:
        key = node.key()
        if key not in self.done:
            self.done[key] = self.make(node)
        return self.done[key]

    def make(self, node) -> Column:
        if node.is_numeric or isinstance(node, (ast.ConstBool, ast.VarBool, ast.Cmp)):
            x = self.exact.of(node)
            return x.column if isinstance(x, Point) else F.lit(x)
        args = [self.of(a) for a in node.args]
        if isinstance(node, ast.Not):
            return -args[0]
        if isinstance(node, ast.And):
            return F.least(*args)
        if isinstance(node, ast.Or):
            return F.greatest(*args)
        if isinstance(node, (ast.Next, ast.Oracle)):
            return self.named(F.lead(args[0], node.steps).over(align.window()))
        if isinstance(node, ast.Until):
            return self.until(*args, node.interval)
        return self.window(args[0], "F" if isinstance(node, ast.Eventually) else "G", node.interval)

    def window(self, c: Column, kind: str, interval: Interval) -> Column:
        if not self.wide:
            return self.named(temporal.samples_window(c, kind, interval))
        self.n += 1
        self.df = temporal.wide_window(self.df, c, kind, interval, f"n{self.n}")
        return F.col(f"n{self.n}")

    def until(self, a: Column, b: Column, interval: Interval) -> Column:
        held, self.n = self.df.withColumns({"a": a, "b": b}), self.n + 1
        name = f"n{self.n}"
        self.df = temporal.until_scan(held, name).drop("a", "b")
        z = F.col(name)
        if interval.untimed:
            return z
        soon = self.window(b, "F", interval)
        if interval.a:
            z = self.window(z, "G", Interval(0, interval.a / 1e9))
        return F.least(soon, z)


def _everywhere(frame: TraceFrame, v) -> DataFrame:
    return frame.rows.select("trace", "t", F.lit(v).alias("v"))


def evaluate(spec, frame: TraceFrame, interpolation: str | Method = "linear", mode: str = "documented", grid: str = "exact", strict: bool = False, wide: bool = False):
    """Robustness (or the value of a numeric expression) as a table trace, t, v, or a float where it is constant.

    wide: on the samples grid, timed windows hold many samples each, hundreds or more; then the work of a row does not grow with its window.  The answers are the same.
    A trace that a signal is missing from, or whose signals or windows share no time, has no rows; rows with a null value are no samples.
    """
    if mode not in MODES or grid not in GRIDS:
        raise ValueError(f"mode is one of {MODES}, grid one of {GRIDS}")
    node = parse(spec)
    for name, kind in node.variables().items():
        frame.has(name, kind)
    if grid == "samples":
        made = Samples(frame, strict, wide)
        column = made.of(node)
        return made.df.select("trace", "t", column.alias("v")).where("v is not null")
    made = Exact(frame, method(interpolation), mode, strict)
    return made.table(made.of(node))


def parse(spec):
    from ..plans.parser import parse_expr

    return parse_expr(spec) if isinstance(spec, str) else spec


def robustness(spec, frame: TraceFrame, interpolation: str | Method = "linear", *, mode: str = "documented", grid: str = "exact", wide: bool = False) -> DataFrame:
    """trace, t, rob: how strongly a formula (text or node) holds; constant formulas have their value at every row of the frame."""
    out = evaluate(spec, frame, interpolation, mode, grid, wide=wide)
    return (out if align.is_table(out) else _everywhere(frame, out)).withColumnRenamed("v", "rob")


def satisfaction(spec, frame: TraceFrame, interpolation: str | Method = "linear", *, mode: str = "documented", grid: str = "exact", wide: bool = False) -> DataFrame:
    """trace, t, sat: whether a formula holds, robustness being 0 or more; strict comparisons are strict unless observed."""
    out = evaluate(spec, frame, interpolation, mode, grid, strict=mode == "documented", wide=wide)
    if not align.is_table(out):
        return _everywhere(frame, out >= 0).withColumnRenamed("v", "sat")
    if grid == "samples":
        return out.select("trace", "t", (F.col("v") >= 0).alias("sat"))
    return temporal.as_truth(out, method(interpolation)).withColumnRenamed("v", "sat")


def numbers(expr, frame: TraceFrame, interpolation: str | Method = "linear") -> DataFrame:
    """trace, t, v of a numeric expression."""
    out = evaluate(expr, frame, interpolation)
    return out if align.is_table(out) else _everywhere(frame, out)
