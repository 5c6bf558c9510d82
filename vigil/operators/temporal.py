"""Temporal operators over signal tables (trace, t, v) of robustness.

Suffix extrema are running extrema in descending order, which Spark evaluates in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.interpolation import Method
from ..plans.ast import Interval
from .align import UP, by_trace, crossings, filled, interpolate_at, together, window


def extremum(kind: str):
    return {"F": F.max, "G": F.min}[kind]


def zero_crossings(s: DataFrame, how: Method) -> DataFrame:
    return crossings(s, F.col("v"), F.lit(0.0), how)


def oracle(s: DataFrame, steps: int) -> DataFrame:
    """The value so many samples later, where there is one."""
    if steps == 0:
        return s
    return s.withColumn("n", F.lead("v", steps).over(window())).where("n is not null").select("trace", "t", F.col("n").alias("v"))


def untimed(s: DataFrame, kind: str, how: Method) -> DataFrame:
    """G or F to the end of the trace."""
    return zero_crossings(s, how).select("trace", "t", extremum(kind)("v").over(window(down=True).rowsBetween(UP, 0)).alias("v"))


def shift_right(s: DataFrame, by: int) -> DataFrame:
    return s.select("trace", (F.col("t") + by).alias("t"), "v")


def shift_left(s: DataFrame, by: int, how: Method) -> DataFrame:
    """Times less by so much; what falls before 0 is cut off, with a sample at 0 if the cut falls between two."""
    kind = dict(s.dtypes)["v"]
    last = F.lag(F.struct("t", "v")).over(window())
    rows = s.withColumn("p", last)
    here = F.struct(F.col("t").alias("t"), F.col("v").alias("v"))
    start = F.struct(F.lit(by).cast("long").alias("t"), how.between(F.col("p"), here, F.lit(by).cast("long")).cast(kind).alias("v"))
    cut = (F.col("p.t") < by) & (F.col("t") > by)
    rows = rows.where(F.col("t") >= by).select("trace", F.explode(F.when(cut, F.array(start, here)).otherwise(F.array(here))).alias("x"))
    return rows.select("trace", (F.col("x.t") - by).alias("t"), F.col("x.v").alias("v"))


def _grid(rows: DataFrame, a: int, b: int | None) -> DataFrame:
    """trace, t, first, last -> the times at which a window [t + a, t + b] gains or loses a sample, the ends of the domain, and midpoints.

    Midpoints tell a stretch that is negative inside from one that is zero at both ends only.
    """
    low, high = F.greatest(F.lit(0).cast("long"), F.col("first") - a), F.col("last") - a
    marks = [F.col("t"), F.col("t") - a, low, high, *([F.col("t") - b] if b is not None else [])]
    points = rows.where(F.col("last") >= a).select("trace", F.explode(F.array_distinct(F.array(*[F.least(F.greatest(m, low), high) for m in marks]))).alias("t")).distinct()
    after = F.lead("t").over(window())
    middle = F.floor((F.col("t") + after) / 2).cast("long")
    points = points.select("trace", "t", middle.alias("m"))
    return points.select("trace", F.explode(F.array_distinct(F.array_compact(F.array("t", "m")))).alias("t"))


def timed(s: DataFrame, kind: str, interval: Interval, how: Method, parts: int | None = None) -> DataFrame:
    """G or F over [t + a, t + b], exact at the times returned.  A window that passes the end of the trace is cut there; the domain ends at end - a."""
    a, b = interval.a, interval.b
    ends = Window.partitionBy("trace")
    signal = zero_crossings(by_trace(s, parts), how)
    grid = _grid(signal.withColumns({"first": F.min("t").over(ends), "last": F.max("t").over(ends)}), a, b).withColumn("g", F.lit(1))
    probes = F.array_distinct(F.array_compact(F.array(F.col("t"), F.col("t") + a, *([F.col("t") + b] if b is not None else []))))
    asked = grid.select("trace", F.col("t").alias("g"), F.explode(probes).alias("t")).select("trace", "t", (F.col("g") == F.col("t")).alias("g"))
    rows = signal.select("trace", "t", "v", F.lit(False).alias("g")).unionByName(asked.select("trace", "t", F.lit(None).cast("double").alias("v"), "g"))
    rows = by_trace(rows, parts).groupBy("trace", "t").agg(F.max("v").alias("v"), F.max("g").alias("g"))
    here = F.when(F.col("v").isNotNull(), F.struct(F.col("t").alias("t"), F.col("v").alias("v")))
    rows = rows.withColumns({"p": F.last(here, True).over(window().rowsBetween(UP, 0)), "q": F.last(here, True).over(window(down=True).rowsBetween(UP, 0))})
    inside = F.col("p").isNotNull() & F.col("q").isNotNull()
    rows = rows.select("trace", "t", "g", F.when(inside, how.at(F.col("p"), F.col("q"), F.col("t"))).alias("v"))
    if b is None:
        later = rows.select("trace", (F.col("t") - a).alias("t"), extremum(kind)("v").over(window(down=True).rowsBetween(UP, 0)).alias("v")).where("v is not null")
        return rows.where("g").select("trace", "t").join(later, ["trace", "t"]) if a else rows.where("g and v is not null").select("trace", "t").join(later, ["trace", "t"])
    return rows.withColumn("v", _between(rows, "v", kind, a, b)).where("g and v is not null").select("trace", "t", "v")


def _between(rows: DataFrame, name: str, kind: str, a: int, b: int) -> Column:
    """The extremum of a column over the rows in [t + a, t + b], for the rows of which t + a and t + b are times of rows too.

    Time is cut into blocks of b - a, so a window is the end of one block and the start of the next: an extremum that runs backwards through the one and one that runs
    forwards through the other, each read at one time.  So the cost of a row does not grow with its window, as that of a range frame does.
    """
    at = lambda c, by: F.max(c).over(window().rangeBetween(by, by))
    if a == b:
        return at(F.col(name), a)
    block = Window.partitionBy("trace", F.floor(F.col("t") / (b - a)))
    rest = extremum(kind)(name).over(block.orderBy(F.desc("t")).rangeBetween(UP, 0))
    begun = extremum(kind)(name).over(block.orderBy("t").rangeBetween(UP, 0))
    both = {"F": F.greatest, "G": F.least}[kind]
    return both(at(rest, a), at(begun, b))


def _scan(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """z[i] = max(low[i], min(high[i], z[i - 1])), from z[0] = low[0] on: clamps are composed over runs of doubling length."""
    low, high = low.copy(), high.copy()
    high[0] = low[0]
    d = 1
    while d < len(low):
        low[d:], high[d:] = np.maximum(low[d:], np.minimum(high[d:], low[:-d])), np.maximum(low[d:], np.minimum(high[d:], high[:-d]))
        d *= 2
    return low


def _scanned(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by trace, latest first, each with z = max(min(a, b), min(a, z of the row after)).  One number is carried, however long the trace."""
    trace, z = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("a", "b"))
        own = batch.column("trace").dictionary_encode()
        k = np.where(np.asarray(own.indices.is_null()), -1, own.indices.fill_null(0).to_numpy(zero_copy_only=False))
        low, high = np.minimum(a, b), a.copy()
        first = np.append(True, k[1:] != k[:-1])
        if z is not None and batch.column("trace")[0].as_py() == trace:
            low[0] = max(low[0], min(high[0], z))
        high[first] = low[first]  # a clamp to one number is where a trace begins
        out = _scan(low, high)
        trace, z = batch.column("trace")[batch.num_rows - 1].as_py(), out[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])


def until_scan(rows: DataFrame, name: str = "v", parts: int | None = None) -> DataFrame:
    """rows (trace, t, a, b and any others) with a until b in a column of that name, streamed backwards through each partition; rows that repeat a time stay rows."""
    ordered = by_trace(rows, parts).sortWithinPartitions("trace", F.desc("t"))
    return ordered.mapInArrow(lambda it: _scanned(it, name), T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def until(x: DataFrame, y: DataFrame, how: Method, parts: int | None = None) -> DataFrame:
    rows = crossings(filled(together(parts, a=x, b=y), ["a", "b"], how), F.col("a"), F.col("b"), how)
    return until_scan(rows.select("trace", "t", "a", "b"), parts=parts).select("trace", "t", "v")


def without_runs(s: DataFrame) -> DataFrame:
    """Of each run of equal values the first sample, and the last sample of the trace."""
    w = window()
    same = F.lag("v").over(w).eqNullSafe(F.col("v")) & F.lag("t").over(w).isNotNull()
    return s.withColumn("drop", same & F.lead("t").over(w).isNotNull()).where("not drop").select("trace", "t", "v")


def value_at(s: DataFrame, probes: DataFrame, how: Method) -> DataFrame:
    return interpolate_at(s, probes, how)


def as_truth(s: DataFrame, how: Method) -> DataFrame:
    """v >= 0 at the samples and where v changes its sign."""
    return zero_crossings(s, how).select("trace", "t", (F.col("v") >= 0).alias("v"))


def samples_window(column: Column, kind: str, interval: Interval) -> Column:
    """G or F over the samples in [t + a, t + b] of a frame with one row per time: no grid, one window.  The work of a row grows with its window; see wide_window."""
    if interval.untimed:
        return extremum(kind)(column).over(window(down=True).rowsBetween(UP, 0))
    if interval.b is None:
        return extremum(kind)(column).over(window(down=True).rangeBetween(UP, -interval.a))
    return extremum(kind)(column).over(window().rangeBetween(interval.a, interval.b))


def wide_window(df: DataFrame, column: Column, kind: str, interval: Interval, name: str) -> DataFrame:
    """df with samples_window() in a column of that name, by way of rows at both ends of each window, so that the work of a row does not grow with it.  Rows that repeat a time stay rows."""
    if interval.b is None:
        return df.withColumn(name, samples_window(column, kind, interval))
    a, b = interval.a, interval.b
    others = [c for c in df.columns if c not in ("trace", "t")]
    own = F.struct(F.col("t").alias("t"), column.alias(name), F.struct(*others).alias("row"))
    kinds = df.withColumn(name, column).schema
    empty = F.lit(None).cast(T.StructType([kinds[c] for c in others])).alias("row")
    ends = [F.struct((F.col("t") + by).alias("t"), F.lit(None).cast(kinds[name].dataType).alias(name), empty) for by in {a, b} - {0}]
    rows = df.select("trace", F.explode(F.array(own, *ends)).alias("x")).select("trace", "x.*")
    out = rows.withColumn(name, _between(rows, name, kind, a, b)).where("row is not null")
    return out.select("trace", "t", *[F.col("row").getField(c).alias(c) for c in others], name)
