"""Arithmetic on Columns by the rules of IEEE 754, whatever the session's ANSI setting is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import dtype

INF = float("inf")
#: The least number below zero: what a strict comparison has where both sides are equal, in boolean monitoring.
HAIR = -5e-324


def divide(a: Column, b: Column) -> Column:
    """a / b; division by zero is infinite, or not a number for 0 / 0.  The sign of a zero divisor counts.  Null if either is."""
    sign = F.when(b.cast("string").startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(F.when(a > 0, F.lit(INF)).otherwise(F.lit(-INF)) * sign)
    return F.when((b == 0) & a.isNotNull(), by_zero).otherwise(a / F.when(b != 0, b))


def exceeds(a: Column, b: Column | float) -> Column:
    """a > b by IEEE 754: false where either is not a number, which Spark orders last."""
    b = b if isinstance(b, Column) else F.lit(b)
    return (a > b) & ~F.isnan(a) & ~F.isnan(b)


def power(a: Column, b: Column) -> Column:
    """a to the power of b; a negative base to a fraction is not a number."""
    return F.pow(a.cast("double"), b.cast("double"))


def truth(v: Column) -> Column:
    """A truth value as robustness."""
    return F.when(v, F.lit(INF)).otherwise(F.lit(-INF))


def cast(v: Column, kind: dtype) -> Column:
    """v as another signal type; fractions are cut off and what does not fit raises."""
    if kind is dtype.uint64:
        whole = v.cast("decimal(38,0)") if kind is not dtype.float64 else v
        return F.when((whole < 0) | (whole > F.lit(2**64 - 1).cast("decimal(38,0)")), F.raise_error(F.lit("value does not fit uint64"))).otherwise(whole.cast("decimal(20,0)"))
    return v.cast(kind.spark)
