"""Metadata, lookup and alignment of signal tables.

Tables are put side by side by a union that is partitioned by trace once; grouping by (trace, t) and every window after it need no
other exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.interpolation import Held, Method

UP = Window.unboundedPreceding


def by_trace(df: DataFrame, parts: int | None) -> DataFrame:
    """df in so many partitions by trace; None leaves their number to Spark, which merges them by their compressed size."""
    return df.repartition(parts, "trace") if parts else df.repartition("trace")


def window(*, down: bool = False):
    return Window.partitionBy("trace").orderBy(F.desc("t") if down else "t")


def bounds(s: DataFrame) -> DataFrame:
    """trace, start, end, n of each trace."""
    return s.groupBy("trace").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"))


def is_empty(s: DataFrame, traces: DataFrame) -> DataFrame:
    """trace, empty: whether the signal has no sample there, for each of the traces (trace)."""
    found = traces.select("trace").distinct().join(s.select("trace").distinct().withColumn("found", F.lit(True)), "trace", "left")
    return found.select("trace", F.col("found").isNull().alias("empty"))


def time_points(s: DataFrame) -> DataFrame:
    return s.select("trace", "t")


def at_exact(s: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (trace, t) that are sample times, with the value."""
    return probes.join(s, ["trace", "t"])


def _around(df: DataFrame, name: str) -> DataFrame:
    """df with p_name and q_name: the samples (t, v) of the column at or before each row, and at or after it."""
    here = F.when(F.col(name).isNotNull(), F.struct(F.col("t").alias("t"), F.col(name).alias("v")))
    return df.withColumns({f"p_{name}": F.last(here, True).over(window().rowsBetween(UP, 0)), f"q_{name}": F.last(here, True).over(window(down=True).rowsBetween(UP, 0))})


def _method(how: Method, kind: str) -> Method:
    return Held() if kind == "boolean" and how.name == "linear" else how


def together(parts: int | None = None, /, **tables: DataFrame) -> DataFrame:
    """trace, t and a column for each table, one row for each time that any of them has."""
    some, names = [], list(tables)
    for n, s in tables.items():
        kinds = {m: dict(tables[m].dtypes)["v"] for m in names}
        some.append(s.select("trace", "t", *[(F.col("v") if m == n else F.lit(None).cast(kinds[m])).alias(m) for m in names]))
    out = some[0]
    for p in some[1:]:
        out = out.unionByName(p)
    return by_trace(out, parts).groupBy("trace", "t").agg(*[F.max(n).alias(n) for n in names])


def filled(df: DataFrame, names: list[str], how: Method, *, clip: bool = True) -> DataFrame:
    """df of together() with every column interpolated; with clip, only the times that all signals span."""
    kinds = dict(df.dtypes)
    for n in names:
        df = _around(df, n)
    values = {n: _method(how, kinds[n]).at(F.col(f"p_{n}"), F.col(f"q_{n}"), F.col("t")).cast(kinds[n]) for n in names}
    if clip:
        for n in names:
            df = df.where(F.col(f"p_{n}").isNotNull() & F.col(f"q_{n}").isNotNull())
    return df.select("trace", "t", *[v.alias(n) for n, v in values.items()])


def interpolate_at(s: DataFrame, probes: DataFrame, how: Method, parts: int | None = None) -> DataFrame:
    """The value at each probe (trace, t), clamped outside the samples; traces without samples give no rows.  An as-of join by union and windows."""
    marked = s.select("trace", "t", "v", F.lit(0).alias("probe")).unionByName(probes.select("trace", "t", F.lit(None).cast(dict(s.dtypes)["v"]).alias("v"), F.lit(1).alias("probe")))
    rows = by_trace(marked, parts).groupBy("trace", "t").agg(F.max("v").alias("v"), F.max("probe").alias("probe"))
    kind = dict(s.dtypes)["v"]
    rows = _around(rows, "v").where("probe = 1 and (p_v is not null or q_v is not null)")
    return rows.select("trace", "t", _method(how, kind).at(F.col("p_v"), F.col("q_v"), F.col("t")).cast(kind).alias("v"))


def sync_points(a: DataFrame, b: DataFrame) -> DataFrame:
    """The times of either table at which both have a value."""
    rows = together(a=a, b=b)
    return filled(rows, ["a", "b"], METHOD_OF_TIMES).select("trace", "t")


METHOD_OF_TIMES = Held()


def crossings(df: DataFrame, a: Column, b: Column, how: Method) -> DataFrame:
    """df (trace, t, and numeric columns that a and b are made of) with a row wherever a and b change order between two rows; its columns are interpolated."""
    values = [c for c in df.columns if c not in ("trace", "t")]
    if how.name != "linear":
        return df
    w = window()
    now = F.struct("t", *values, (a - b).alias("d"))
    rows = df.withColumn("now", now).withColumn("last", F.lag("now").over(w))
    met = how.meeting(F.col("last.t"), F.col("now.t"), F.col("last.d"), F.col("now.d"))
    rows = rows.withColumn("met", met)
    own = F.struct("t", *values)

    def between(c: str) -> Column:
        p = F.struct(F.col("last.t").alias("t"), F.col(f"last.{c}").alias("v"))
        q = F.struct(F.col("now.t").alias("t"), F.col(f"now.{c}").alias("v"))
        return how.between(p, q, F.col("met"))

    new = F.struct(F.col("met").alias("t"), *[between(c).alias(c) for c in values])
    both = F.when(F.col("met").isNotNull(), F.array(new, own)).otherwise(F.array(own))
    return rows.select("trace", F.explode(both).alias("x")).select("trace", "x.*")


Sig = object  # a table or a constant


def is_table(s) -> bool:
    return isinstance(s, DataFrame)


def unary(s: Sig, f: Callable[[Column], Column], constant: Callable) -> Sig:
    return s.select("trace", "t", f(F.col("v")).alias("v")) if is_table(s) else constant(s)


def binary(x: Sig, y: Sig, f: Callable[[Column, Column], Column], constant: Callable, how: Method, cross: bool, parts: int | None = None) -> Sig:
    """f of two signals over the times of both, with cross also where they change order.  Constants are folded or become literals."""
    if not is_table(x) and not is_table(y):
        return constant(x, y)
    if is_table(x) and is_table(y):
        rows = filled(together(parts, a=x, b=y), ["a", "b"], how)
        a, b = F.col("a"), F.col("b")
    else:
        rows = (x if is_table(x) else y).select("trace", "t", F.col("v").alias("a" if is_table(x) else "b"))
        a = F.col("a") if is_table(x) else F.lit(x)
        b = F.col("b") if is_table(y) else F.lit(y)
    if cross:
        rows = crossings(rows, a, b, how)
    return rows.select("trace", "t", f(a, b).alias("v"))
