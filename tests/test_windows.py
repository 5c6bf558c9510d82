"""Windows whose work does not grow with their width, the scan of until, and operators on signals."""

import math
import subprocess
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.functions.interpolation import METHODS
from vigil.operators import logic, temporal
from vigil.plans.ast import Interval

numbers = st.floats(-5, 5) | st.just(math.inf) | st.just(-math.inf)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(numbers, numbers), min_size=1, max_size=40))
def test_scan_of_clamps(pairs):
    low, high = np.array([min(p) for p in pairs]), np.array([max(p) for p in pairs])
    want, z = [], -math.inf
    for a, b in zip(low, high, strict=True):
        z = max(a, min(b, z))
        want.append(z)
    assert temporal._scan(low, high).tolist() == want


@pytest.mark.parametrize("interval", [(0, 3), (2, 5), (4, 4), (0, 0), (1, None)])
@pytest.mark.parametrize("kind", ["F", "G"])
def test_wide_windows(spark, interval, kind):
    rows = [(k, t * 10**9, float((t * 7919 + (k or 0)) % 31)) for k in (1, 2, None) for t in (0, 1, 2, 3, 5, 8, 8, 13, 14, 15, 16, 40)]
    df = spark.createDataFrame(rows, "trace long, t long, v double")
    i = Interval(*interval)
    narrow = df.withColumn("z", temporal.samples_window(df["v"], kind, i))
    wide = temporal.wide_window(df, df["v"], kind, i, "z")
    assert wide.columns == narrow.columns and wide.count() == len(rows)
    assert sorted(map(str, wide.collect())) == sorted(map(str, narrow.collect()))


def test_until_keeps_rows_that_repeat_a_time(spark):
    rows = [("x", 0, 1.0, -1.0, 7), ("x", 1, 1.0, 2.0, 8), ("x", 1, 1.0, 2.0, 9), ("x", 2, 3.0, 0.0, 10), (None, 0, 1.0, 5.0, 11), ("y", 0, 4.0, 5.0, 12)]
    got = temporal.until_scan(spark.createDataFrame(rows, "trace string, t long, a double, b double, more int"), "z").collect()
    assert {r["more"]: r["z"] for r in got} == {7: 1.0, 8: 1.0, 9: 1.0, 10: 0.0, 11: 1.0, 12: 4.0}
    assert temporal.until_scan(spark.createDataFrame([], "trace string, t long, a double, b double")).count() == 0


def test_signal_operators(spark):
    x = spark.createDataFrame([(1, 0, True), (1, 10, False)], "trace long, t long, v boolean")
    y = spark.createDataFrame([(1, 5, True), (1, 10, True)], "trace long, t long, v boolean")
    values = lambda s: [(r["t"], r["v"]) for r in s.orderBy("t").collect()]
    assert values(logic.and_(x, y)) == [(5, True), (10, False)] and values(logic.or_(x, y, METHODS["linear"])) == [(5, True), (10, True)]
    assert values(logic.not_(x)) == [(0, False), (10, True)] and values(logic.xor(x, True)) == [(0, False), (10, True)]
    assert values(logic.implies(x, y)) == [(5, True), (10, True)] and values(logic.equiv(x, y)) == [(5, True), (10, False)]
    assert logic.and_(True, False) is False and logic.not_(False) is True and logic.power(2.0, 3.0) == 8.0
    n = spark.createDataFrame([(1, 0, 2.0), (1, 10, 3.0)], "trace long, t long, v double")
    assert values(logic.power(n, 2.0)) == [(0, 4.0), (10, 9.0)]


def test_formulas_are_printed():
    run = lambda *a: subprocess.run([sys.executable, "-m", "vigil", *a], capture_output=True, text=True)
    shown = run("G(error -> F[0,5] x > 3.0)")
    assert shown.returncode == 0 and "x: float64" in shown.stdout and "Eventually [0, 5]" in shown.stdout
    assert run("G(").returncode == 1 and run().returncode == 2
