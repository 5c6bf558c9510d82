"""Many traces in a DataFrame: binding of columns to signals, time encoding, checks, and signal tables.

A *signal table* has the columns trace, t (long nanoseconds) and v; a constant is a plain Python value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SignalNotPresent
from ..types import NS, dtype
from .signals import Signal, Trace

KEYS = ["trace", "t"]
#: Rows of a frame to a partition of what follows signals between samples; each may become eight there, sorted several times in one task.
ROWS = 1 << 15


def time_ns(df: DataFrame, column: str) -> Column:
    """A time column as long nanoseconds since 1970; longs are taken as nanoseconds, other numbers as seconds.  Timestamps without a zone do not depend on the session's."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c) * 1000
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c) * 1000
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long") * 86_400 * NS
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.rint(c.cast("double") * NS).cast("long")
    return c.cast("long")


@dataclass
class TraceFrame:
    """Rows (trace, time, one column per signal), or constants.

    signals: name -> (column or Column expression, type).  A null value is no sample of that signal; if ``aligned`` no
    signal of a row is ever null, and formulas without temporal operators become plain projections.  ``unit``: nanoseconds of one
    step of a long time column.
    """

    df: DataFrame
    trace: str
    time: str
    signals: dict[str, tuple[str | Column, dtype]]
    aligned: bool = False
    unit: int = 1
    constants: dict[str, tuple[object, dtype]] = field(default_factory=dict)

    def __post_init__(self):
        columns = {n: F.col(c) if isinstance(c, str) else c for n, (c, _) in self.signals.items()}
        at = time_ns(self.df, self.time) * F.lit(self.unit)
        self.rows = self.df.select(F.col(self.trace).alias("trace"), at.alias("t"), *[c.alias(f"s_{i}") for i, c in enumerate(columns.values())])
        self.places = {n: f"s_{i}" for i, n in enumerate(columns)}
        self._tables: dict[str, DataFrame] = {}
        self._parts: int | None = None

    def parts(self) -> int:
        """Partitions by trace that hold about ROWS rows each, however many rows there are; rows are counted once, which takes only the footers of Parquet files."""
        if self._parts is None:
            spark = self.df.sparkSession
            least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
            self._parts = max(least, -(-self.df.count() // ROWS), 1)
        return self._parts

    def kind(self, name: str) -> dtype | None:
        found = self.signals.get(name) or self.constants.get(name)
        return found[1] if found else None

    def has(self, name: str, kind: dtype) -> None:
        if self.kind(name) is not kind:
            raise SignalNotPresent(name, kind.name)

    def table(self, name: str, kind: dtype):
        """The signal of this name: a table, or a constant."""
        self.has(name, kind)
        if name in self.constants:
            return self.constants[name][0]
        if name not in self._tables:
            v = F.col(self.places[name])
            rows = self.rows if self.aligned else self.rows.where(v.isNotNull())
            self._tables[name] = rows.select("trace", "t", v.alias("v"))
        return self._tables[name]

    def checked(self) -> TraceFrame:
        """The same frame whose rows raise while they are read if a trace repeats a time, a time is null, or a value is NaN."""
        from pyspark.sql import Window

        w = Window.partitionBy("trace").orderBy("t")
        bad = F.col("t").isNull() | (F.lag("t").over(w) == F.col("t"))
        for n, (_, kind) in self.signals.items():
            if kind is dtype.float64:
                bad = bad | F.coalesce(F.isnan(self.places[n]), F.lit(False))
        fine = F.when(bad, F.raise_error(F.lit("a trace repeats a time, or has a null time or NaN"))).otherwise(F.col("t"))
        self.rows = self.rows.withColumn("t", fine)
        self._tables = {}
        return self


def from_trace(spark: SparkSession, trace: Trace) -> TraceFrame:
    """A frame with one trace, the given one; signals keep their own times."""
    sampled = {n: s for n, s in trace.signals.items() if s.value is None}
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.LongType()), *[T.StructField(f"v{i}", s.kind.spark) for i, s in enumerate(sampled.values())]])
    rows: dict[int, list] = {}
    for i, s in enumerate(sampled.values()):
        for t, v in zip(s._times, s._values, strict=True):
            rows.setdefault(t, [None] * len(sampled))[i] = v
    from decimal import Decimal

    fix = lambda v, s: Decimal(v) if v is not None and s.kind is dtype.uint64 else v
    data = [(0, t, *(fix(v, s) for v, s in zip(r, sampled.values(), strict=True))) for t, r in sorted(rows.items())]
    df = spark.createDataFrame(data, schema)
    return TraceFrame(df, "id", "at", {n: (f"v{i}", s.kind) for i, (n, s) in enumerate(sampled.items())}, constants={n: (s.value, s.kind) for n, s in trace.signals.items() if s.value is not None})


def read(spark: SparkSession, path: str, format: str = "parquet", *, trace: str, time: str, signals: dict, aligned: bool = False, unit: int = 1, **options) -> TraceFrame:
    """A frame from files of any format that Spark reads."""
    return TraceFrame(spark.read.format(format).options(**options).load(path), trace, time, signals, aligned, unit)


def to_signal(table: DataFrame, cls: type[Signal], **how) -> Signal:
    """A table with one trace as a signal in the driver, read in order without holding more than it."""
    out = cls(**how)
    for r in table.select("t", "v").orderBy("t").toLocalIterator():
        out._push(r["t"], r["v"])
    return out
