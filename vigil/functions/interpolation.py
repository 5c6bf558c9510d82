"""Values between samples, as Column expressions over the samples around a time.

Arguments p and q are structs (t, v) of the sample before or at the time and of the one after or at it; either may be null, and
a time outside all samples takes the value of the nearest one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import NS


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


class Method:
    name = ""

    def between(self, p: Column, q: Column, t: Column) -> Column:
        raise NotImplementedError

    def at(self, p: Column, q: Column, t: Column) -> Column:
        """The value at t, clamped outside the samples."""
        inside = F.when(p["t"] == t, p["v"]).when(q["t"] == t, q["v"]).otherwise(self.between(p, q, t))
        return F.when(p.isNull(), q["v"]).when(q.isNull(), p["v"]).otherwise(inside)

    def meeting(self, t1: Column, t2: Column, d1: Column, d2: Column) -> Column | None:
        """The time strictly between two samples at which their difference, d1 then d2, is zero; None where values jump."""
        return None


class Constant(Method):
    """The value of the sample before."""

    name = "constant"

    def between(self, p, q, t):
        return p["v"]


class Nearest(Method):
    """The value of the nearer sample; the later one if both are as near."""

    name = "nearest"

    def between(self, p, q, t):
        return F.when(q["t"] - t > t - p["t"], p["v"]).otherwise(q["v"])


class Linear(Method):
    """Numbers on the line between both samples, truth values as they were; an infinite end holds the sample before."""

    name = "linear"

    def between(self, p, q, t):
        a, b = p["v"].cast("double"), q["v"].cast("double")
        x = (t - p["t"]).cast("double") / F.nullif((q["t"] - p["t"]).cast("double"), F.lit(0.0))
        # The form that is exact at the ends and monotone between them.
        line = F.when((a <= 0) & (b >= 0) | (a >= 0) & (b <= 0), x * b + (1 - x) * a).when(x == 1, b).otherwise(a + x * (b - a))
        return F.when(finite(a) & finite(b), line).otherwise(a)

    def meeting(self, t1, t2, d1, d2):
        apart = (d1 < 0) & (d2 > 0) | (d1 > 0) & (d2 < 0)
        x = d1 / F.nullif(d1 - d2, F.lit(0.0))
        t = t1 + F.rint((t2 - t1).cast("double") * x).cast("long")
        return F.when(apart & finite(d1) & finite(d2) & (F.abs(d1 - d2) * NS > 1e-10 * (t2 - t1).cast("double")) & (t > t1) & (t < t2), t)


class Held(Constant):
    """Linear for truth values."""

    name = "linear"


METHODS = {m.name: m for m in (Constant(), Nearest(), Linear())}


def method(name: str | Method) -> Method:
    if isinstance(name, Method):
        return name
    if name not in METHODS:
        raise ValueError(f"interpolation is one of {', '.join(METHODS)}, not {name!r}")
    return METHODS[name]
