"""The engine against a naive interpreter that looks at every candidate time, over many random traces at once."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from vigil import Always, And, Cmp, ConstFloat, Eventually, Negate, Not, Or, TraceFrame, Until, VarBool, VarFloat, dtype, parse_expr, robustness, satisfaction
from vigil.types import NS

INF = float("inf")


def naive(node, trace, linear):
    """(first time, last time, break points, value at a time), times in seconds."""
    if isinstance(node, (VarFloat, VarBool)):
        times, values = zip(*trace[node.name], strict=True)
        if isinstance(node, VarBool):
            values = [INF if v else -INF for v in values]

        def at(t):
            i = bisect.bisect_right(times, t) - 1
            if i == len(times) - 1 or not linear or isinstance(node, VarBool):
                return values[i]
            x = (t - times[i]) / (times[i + 1] - times[i])
            return values[i] + x * (values[i + 1] - values[i])

        return times[0], times[-1], list(times), at
    if isinstance(node, ConstFloat):
        return 0, INF, [], lambda t: node.value
    parts = [naive(a, trace, linear) for a in node.args]
    low, high = max(p[0] for p in parts), min(p[1] for p in parts)
    points = sorted({x for p in parts for x in p[2] if low <= x <= high})
    f = [p[3] for p in parts]
    if isinstance(node, Cmp):
        sign = {"<": -1, "<=": -1, ">": 1, ">=": 1}[node.op.value]
        return low, high, points, lambda t: sign * (f[0](t) - f[1](t))
    if isinstance(node, (Not, Negate)):
        return low, high, points, lambda t: -f[0](t)
    if isinstance(node, (And, Or)):
        pick = min if isinstance(node, And) else max
        return low, high, points, lambda t: pick(g(t) for g in f)
    a, b = node.interval.a / NS, INF if node.interval.b is None else node.interval.b / NS
    if isinstance(node, (Always, Eventually)):
        pick = max if isinstance(node, Eventually) else min
        first, last = max(0, low - a), high - a
        inner = sorted({min(max(x, first), last) for p in points for x in (p, p - a, *([p - b] if b < INF else []))}) if last >= first else []
        return first, last, inner, lambda t: pick(f[0](u) for u in {t + a, min(t + b, high), *(p for p in points if t + a <= p <= t + b)})
    assert isinstance(node, Until) and node.interval.untimed

    def until(t):
        best, held = -INF, INF
        for u in sorted({t, *(p for p in points if p > t)}):
            held = min(held, f[0](u))
            best = max(best, min(held, f[1](u)))
        return best

    return low, high, points, until


@pytest.fixture(scope="module")
def traces(spark):
    r, rows, known = random.Random(11), [], {}
    for k in range(40):
        known[k] = {}
        for name in ("x", "y", "p"):
            times = sorted(r.sample(range(r.choice([0, 0, 3]), 24), r.randint(2, 9)))
            known[k][name] = [(t, r.random() < 0.5 if name == "p" else float(r.randint(-4, 4))) for t in times]
            rows += [(k, t * NS, name, float(v)) for t, v in known[k][name]]
    df = spark.createDataFrame(rows, "k long, t long, name string, v double")
    wide = df.groupBy("k", "t").agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in ("x", "y", "p")]).withColumn("p", F.col("p") > 0).cache()
    return TraceFrame(wide, "k", "t", {"x": ("x", dtype.float64), "y": ("y", dtype.float64), "p": ("p", dtype.bool_)}), known


NESTED = [
    "F[1,3](x > 0.0)", "G[0,5](x > y)", "G[2,](x > 0.0 | p)", "F(x > 0.0 & y > 0.0)", "F[0,4](G[1,2](x > 1.0))", "G(p -> F[0,6](x > 0.0))", "!(F[2,7] !p) & x < 3.0", "(x > 0.0) U (y > 0.0)", "F[0,2]((x > -1.0) U (p | y > 2.0))",
]


@pytest.mark.parametrize("text", NESTED)
def test_held_values(traces, text):
    frame, known = traces
    got = {}
    for r in robustness(text, frame, "constant").collect():
        got.setdefault(r["trace"], []).append((r["t"] / NS, r["rob"]))
    for k, trace in known.items():
        low, high, _, f = naive(parse_expr(text), trace, False)
        found = sorted(got.get(k, []))
        assert bool(found) == (high >= low), (k, low, high, found)
        if not found:
            continue
        assert found[0][0] == pytest.approx(low) and found[-1][0] == pytest.approx(high)
        times = [t for t, _ in found]
        for t, v in found:
            assert v == f(t), (text, k, t)
        for t in (low + 0.3 + 0.5 * i for i in range(60)):
            if t < high:
                assert found[bisect.bisect_right(times, t) - 1][1] == f(t), (text, k, t)


@pytest.mark.parametrize("text", ["F[1,3](x > 0.0)", "G[0,5](x > y)", "G[2,](x > 0.5)", "F(x > 0.5 & y > 0.25)", "x > 0.0 | y < 1.0"])
def test_lines(traces, text):
    """With one temporal operator, values at the returned times are exact, and so is the verdict at them."""
    frame, known = traces
    truth = {(r["trace"], r["t"]): r["sat"] for r in satisfaction(text, frame, "linear", mode="documented").collect()}
    n = 0
    for r in robustness(text, frame, "linear").collect():
        low, high, points, f = naive(parse_expr(text), known[r["trace"]], True)
        t = r["t"] / NS
        assert low - 1e-9 <= t <= high + 1e-9
        # The naive window looks at break points only; where two lines cross, the engine may know a point in between.
        inner = [naive(a, known[r["trace"]], True) for a in parse_expr(text).walk() if isinstance(a, (Cmp, And, Or))][0]
        interval = getattr(parse_expr(text), "interval", None)
        if interval is None:
            want = f(t)
        else:
            a, b = interval.a / NS, INF if interval.b is None else interval.b / NS
            end = min(t + b, inner[1])
            steps = [t + a + (end - t - a) * i / 400 for i in range(401)]
            values = [inner[3](min(u, inner[1])) for u in (*steps, *(p for p in inner[2] if t + a <= p <= end))]
            want = max(values) if isinstance(parse_expr(text), Eventually) else min(values)
        assert r["rob"] == pytest.approx(want, abs=0.12), (text, r)
        if abs(r["rob"]) > 1e-6 and (r["trace"], r["t"]) in truth:
            assert truth[r["trace"], r["t"]] == (r["rob"] > 0)
        n += 1
    assert n > 200


@pytest.mark.parametrize(("left", "right"), [("!(F[0,3] !(x > 0.0))", "G[0,3](x > 0.0)"), ("F[0,](x > y)", "F(x > y)"), ("!(p & x > 0.0)", "!p | !(x > 0.0)"), ("X X p", "X[0,2] p")])
def test_laws(traces, left, right):
    frame, _ = traces
    rows = lambda spec: sorted(map(tuple, robustness(spec, frame, "constant").collect()))
    assert rows(left) == rows(right)


def test_until_is_below_eventually(traces):
    frame, _ = traces
    u, f = ({(r["trace"], r["t"]): r["rob"] for r in robustness(s, frame, "constant").collect()} for s in ("(x > 0.0) U (y > 0.0)", "F(y > 0.0)"))
    shared = u.keys() & f.keys()
    assert len(shared) > 100 and all(u[k] <= f[k] for k in shared)


def test_samples_grid_agrees_where_samples_decide(spark):
    rows = [(k, t, float((t * 7 + k * 5) % 11)) for k in range(20) for t in range(0, 30, 1 + k % 4)]
    frame = TraceFrame(spark.createDataFrame(rows, "k long, t long, v double"), "k", "t", {"v": ("v", dtype.float64)}, aligned=True, unit=NS)
    for spec in ("G(v < 9.0)", "F[0,6](v > 8.0)", "(v < 9.0) U (v > 5.0)"):
        exact = {(r["trace"], r["t"]): r["rob"] for r in robustness(spec, frame, "constant").collect()}
        sampled = robustness(spec, frame, "constant", grid="samples").collect()
        assert sampled and all(exact[r["trace"], r["t"]] == r["rob"] for r in sampled)


def test_repeated_times_are_rejected(spark):
    frame = TraceFrame(spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0)], "k long, t long, v double"), "k", "t", {"v": ("v", dtype.float64)}, aligned=True)
    with pytest.raises(Exception, match="repeats a time"):
        frame.checked().rows.collect()
