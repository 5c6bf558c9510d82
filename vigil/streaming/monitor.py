"""Online monitoring of bounded formulas with Structured Streaming.

A verdict at t needs the samples up to t plus the horizon of the formula, so it is given once the watermark has passed that
time.  State is what later verdicts can still need of each trace: samples newer than the last verdict.  Late rows are dropped by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.numeric import INF
from ..operators.evaluate import parse
from ..plans import ast
from ..types import NS, dtype


def horizon(node: ast.Expr) -> int:
    """Nanoseconds that a verdict looks ahead; ValueError where there is no bound."""
    inner = max(map(horizon, node.args), default=0)
    if isinstance(node, (ast.Next, ast.Oracle)):
        raise ValueError("X looks ahead by samples, not by time, so no watermark settles it")
    if isinstance(node, (ast.Always, ast.Eventually, ast.Until)):
        if node.interval.b is None:
            raise ValueError(f"{node} has no last time to look at")
        return inner + node.interval.b
    return inner


def verdicts(node: ast.Expr, times: list[int], values: dict[str, list]) -> list[float]:
    """Robustness over samples of one trace at each of its times."""
    n = len(times)

    def of(x: ast.Expr) -> list[float]:
        if isinstance(x, ast._ConstNum):
            return [float(x.value)] * n
        if isinstance(x, ast.ConstBool):
            return [INF if x.value else -INF] * n
        if isinstance(x, ast.VarBool):
            return [INF if v else -INF for v in values[x.name]]
        if isinstance(x, ast.VarNum):
            return [float(v) for v in values[x.name]]
        a = [of(y) for y in x.args]
        if isinstance(x, (ast.Not, ast.Negate)):
            return [-v for v in a[0]]
        if isinstance(x, ast.Abs):
            return list(map(abs, a[0]))
        if isinstance(x, ast.Add):
            return list(map(sum, zip(*a, strict=True)))
        if isinstance(x, (ast.And, ast.Or)):
            return list(map(min if isinstance(x, ast.And) else max, zip(*a, strict=True)))
        if isinstance(x, ast.Cmp):
            return [_compared(x.op.value, p - q) for p, q in zip(*a, strict=True)]
        if isinstance(x, (ast.Sub, ast.Mul, ast.Div)):
            return _arithmetic(x, a)
        if isinstance(x, ast.Until):
            return _until(times, *a, x.interval)
        pick = max if isinstance(x, ast.Eventually) else min
        return [_extreme(times, a[0], t + x.interval.a, t + x.interval.b, pick) for t in times]

    return of(node)


def _compared(sign: str, d: float) -> float:
    return {"<": -d, "<=": -d, ">": d, ">=": d, "==": -abs(d), "!=": abs(d)}[sign]


def _arithmetic(x: ast.Expr, a: list[list[float]]) -> list[float]:
    if isinstance(x, ast.Sub):
        return [p - q for p, q in zip(*a, strict=True)]
    if isinstance(x, ast.Div):
        from ..operators.evaluate import _divide

        return [_divide(p, q) for p, q in zip(*a, strict=True)]
    out = [1.0] * len(a[0])
    for col in a:
        out = [p * q for p, q in zip(out, col, strict=True)]
    return out


def _extreme(times: list[int], v: list[float], low: int, high: int, pick) -> float:
    return pick((x for t, x in zip(times, v, strict=True) if low <= t <= high), default=-INF if pick is max else INF)


def _until(times: list[int], a: list[float], b: list[float], interval: ast.Interval) -> list[float]:
    out = []
    for t in times:
        best, held = -INF, INF
        for u, x, y in zip(times, a, b, strict=True):
            if u < t:
                continue
            held = min(held, x)
            if t + interval.a <= u <= t + interval.b:
                best = max(best, min(held, y))
        out.append(best)
    return out


def monitor(spec, stream: DataFrame, *, trace: str, time: str, signals: dict[str, tuple[str, dtype]], delay: str = "10 minutes") -> DataFrame:
    """A stream of (trace, time, rob), a row for each sample once its verdict is final; robustness over samples.

    stream has a timestamp column ``time``; rows later than ``delay`` behind the newest are dropped.  Use it with append output.
    """
    node = parse(spec)
    names = list(node.variables())
    ahead = horizon(node)
    kind = stream.schema[trace].dataType.simpleString()
    columns = [F.col(signals[n][0]).alias(f"s_{i}") for i, n in enumerate(names)]
    rows = stream.select(F.col(trace).alias("trace"), F.col(time).alias("time"), *columns).withWatermark("time", delay)
    kinds = [f"s_{i} array<{'boolean' if signals[n][1] is dtype.bool_ else 'double'}>" for i, n in enumerate(names)]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [[] for _ in range(len(names) + 2)]
        times, values, final = list(held[0]), [list(v) for v in held[1:-1]], held[-1][0] if len(held[-1]) else -(1 << 62)
        for pdf in batches:
            times += (pdf["time"].astype("datetime64[ns]").astype("int64")).tolist()
            for i, col in enumerate(values):
                col += pdf[f"s_{i}"].tolist()
        order = sorted(range(len(times)), key=times.__getitem__)
        times, values = [times[i] for i in order], [[c[i] for i in order] for c in values]
        now = state.getCurrentWatermarkMs() * 1_000_000
        ready = [i for i, t in enumerate(times) if final < t <= now - ahead - 1]
        if ready:
            rob = verdicts(node, times, dict(zip(names, values, strict=True)))
            final = times[ready[-1]]
            yield pd.DataFrame({"trace": [key[0]] * len(ready), "time": [datetime.fromtimestamp(times[i] // NS, timezone.utc).replace(tzinfo=None, microsecond=times[i] % NS // 1000) for i in ready], "rob": [float(rob[i]) for i in ready]})
        kept = [i for i, t in enumerate(times) if t > final]
        if kept:
            state.update(([times[i] for i in kept], *[[c[i] for i in kept] for c in values], [final]))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (times[kept[0]] + ahead) // 1_000_000 + 2))
        elif state.exists:
            state.remove()

    schema = ", ".join(["t array<bigint>", *kinds, "final array<bigint>"])
    return rows.groupBy("trace").applyInPandasWithState(step, f"trace {kind}, time timestamp, rob double", schema, "append", GroupStateTimeout.EventTimeTimeout)
